"""Main text of web pages by the maximum-scoring subsequence of their tokens.

All weights are log odds learned from labelled pages (labelled_pages.py). Elements come first: an element's tag, the
names that its author gave it, and the number of words and links in it say whether it belongs to the main text. One
that doesn't (a menu, an advert, a form, reader comments) becomes a single token without words. Then a page is a line of
tokens: words score positive, tags and such furniture negative. One linear scan finds the contiguous region of the
highest sum, and the blocks of that region are the result. Equal sums: the earliest and longest region; a heading right
before the region belongs to it.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .arrow import small_batches, texts_of
from .labelled_pages import labelled

SCHEMA = "page_id long, url string, text string, n_chars long"
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?:/?[a-zA-Z])[^>]*(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "math")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARTS = re.compile(r"[a-z]+")


class Segment:
    """A run of text: where it begins, the block it is in, its kind of words, whether a link's."""

    __slots__ = ("at", "text", "block", "kind", "words")

    def __init__(self, at: int, text: str, block: int, kind: str):
        self.at, self.text, self.block, self.kind = at, text, block, kind
        self.words = len(text.split())


class Element:
    """An element: its tag, attributes, range of items and parent's number (-1: none)."""

    __slots__ = ("tag", "raw", "first", "end", "up")

    def __init__(self, tag: str, raw: str, first: int, up: int):
        self.tag, self.raw, self.first, self.end, self.up = tag, raw, first, first + 1, up


class Page:
    """A page's items in order: Segments, and elements' numbers where they open, ~numbers where they close."""

    def __init__(self, page: str):
        self.items: list = []
        self.elements: list[Element] = []
        self._parse(page)
        self.words = [0, *accumulate(0 if isinstance(x, int) else x.words for x in self.items)]
        self.linked = [0, *accumulate(x.words if not isinstance(x, int) and x.kind == "#a" else 0 for x in self.items)]

    def _parse(self, page: str) -> None:
        items, elements = self.items, self.elements
        open_: list[int] = []
        of_tag: dict[str, list[int]] = {}  # places in open_
        fences: list[int] = []  # places in open_ that a stray end tag doesn't pass
        block = links = headings = 0
        at, n = 0, len(page)

        def text(start: int, end: int) -> None:
            if end > start:
                raw = page[start:end]
                kind = "#a" if links else "#h" if headings else "#w"
                items.append(Segment(start, html.unescape(raw) if "&" in raw else raw, block, kind))

        def close(k: int) -> None:
            nonlocal links, headings
            while len(open_) > k:
                e = open_.pop()
                tag = elements[e].tag
                of_tag[tag].pop()
                if fences and fences[-1] == len(open_):
                    fences.pop()
                links -= tag == "a"
                headings -= tag in _HEADINGS
                items.append(~e)
                elements[e].end = len(items)

        while at < n:
            m = _TOKEN.search(page, at)
            if not m:
                text(at, n)
                break
            text(at, m.start())
            at = m.end()
            if not m[2]:
                continue  # a comment, a declaration, or a tag that the page's end cuts off
            tag = m[2].lower()
            if tag in BLOCKS:
                block += 1
            if m[1]:
                places = of_tag.get(tag)
                if places and (tag in ("html", "body") or not fences or places[-1] >= fences[-1]):
                    close(places[-1])
                continue
            if tag in _RAW:
                end = _RAW[tag].search(page, at)
                at = n if end.start() == n else page.find(">", end.start()) + 1 or n
                continue
            top = elements[open_[-1]].tag if open_ else ""
            if tag == "body" and of_tag.get("head"):
                close(of_tag["head"][-1])
            elif tag not in VOID and (tag in BLOCKS and top == "p" or tag == top and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                close(len(open_) - 1)
            e = len(elements)
            elements.append(Element(tag, m[3] or "", len(items), open_[-1] if open_ else -1))
            items.append(e)
            if tag in VOID:
                if tag == "br":
                    items.append(Segment(m.start(), " ", block, "#w"))
                continue
            of_tag.setdefault(tag, []).append(len(open_))
            if tag in ("article", "main", "body"):
                fences.append(len(open_))
            open_.append(e)
            links += tag == "a"
            headings += tag in _HEADINGS
        close(0)

    def features(self, e: Element) -> list[str]:
        """What an element's size says: the magnitude of its words and the share that links have of them."""
        words, linked = self.words[e.end] - self.words[e.first], self.linked[e.end] - self.linked[e.first]
        return [f"words {min(words.bit_length(), 9)}", f"links {(2 * linked + words) // (2 * words) + (4 * linked > words) if words else 3}"]


def names_of(raw: str) -> list[str]:
    """The names of an element: its classes, id and role, and whether it is hidden."""
    if not raw.strip():
        return []
    out: list[str] = []
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            out += html.unescape(value).lower().split()
        elif name == "role":
            out += ["role:" + x for x in value.lower().split()]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            out.append("hidden:")
    return out


class Model:
    """Weights of elements' features and of tokens: positive for the main text."""

    def __init__(self, features: dict[str, float], tokens: dict[str, float]):
        self.features, self.tokens = features, tokens

    def named(self, names: list[str]) -> float:
        """The weight of an element's names. A name that no labelled page has counts as the mean of its parts."""
        total = 0.0
        for name in names:
            known = self.features.get("." + name)
            if known is None:
                parts = _PARTS.findall(name) if ":" not in name else []
                known = sum(self.features.get("-" + p, 0.0) for p in parts) / len(parts) if parts else 0.0
            total += known
        return total

    def furniture(self, page: Page) -> list[bool]:
        """Whether each element, or one around it, isn't of the main text."""
        out: list[bool] = []
        inside: list[bool] = []  # an element that is said to hold main text is around
        for e in page.elements:
            if e.up >= 0 and out[e.up]:
                out.append(True)
                inside.append(False)
                continue
            held = e.up >= 0 and inside[e.up]
            tag = self.features.get(f"<{e.tag} in" if held else f"<{e.tag}", 0.0)
            names = names_of(e.raw)
            own = tag + self.named(names)
            # a plain tag is no evidence: what nothing names is left to the scan
            judged = own if (names or tag < -2) and e.tag not in ("html", "body") else 1.0
            out.append(judged + sum(self.features.get(f, 0.0) for f in page.features(e)) < 0 if judged < 0 else False)
            inside.append(held or (own > 1 and not out[-1]))
        return out

    def weight(self, token: str) -> float:
        return self.tokens.get(token, self.tokens["<>"])


def _odds(yes: Counter, no: Counter, smooth: float = 1.0) -> dict[str, float]:
    a, b = sum(yes.values()), sum(no.values())
    keys = yes.keys() | no.keys()
    return {k: math.log((yes[k] + smooth) / (a + smooth * len(keys))) - math.log((no[k] + smooth) / (b + smooth * len(keys))) for k in keys}


def tokens_of(page: Page, furniture: list[bool]) -> list[str]:
    """A kind for each item: words "#...", tags "<...", "" inside furniture but for its beginning."""
    out = []
    depth = 0
    for x in page.items:
        if not isinstance(x, int):
            out.append("" if depth else x.kind)
            continue
        e = x if x >= 0 else ~x
        tag = page.elements[e].tag
        if not furniture[e]:
            out.append(f"<{tag}" if x >= 0 else f"</{tag}")
        else:
            out.append("[]" if not depth and x >= 0 else "")
            if tag not in VOID:
                depth += 1 if x >= 0 else -1
    return out


@lru_cache(maxsize=1)
def model() -> Model:
    """The weights that the labelled pages give. Words weigh 0.5 at least (a link's words 0.1 at most), tags and
    furniture -0.1 at most and -2 at least."""
    pages = [(Page(text), ranges) for text, ranges in labelled()]
    yes, no, names_yes, names_no = Counter(), Counter(), Counter(), Counter()
    for page, ranges in pages:
        starts = [r[0] for r in ranges]
        is_main = lambda at, starts=starts, ranges=ranges: bool((k := bisect_right(starts, at)) and at < ranges[k - 1][1])
        main = [0, *accumulate(0 if isinstance(x, int) else x.words * is_main(x.at) for x in page.items)]
        inside: list[bool] = []
        outside: list[bool] = []  # in an element that holds no main text, whose parts tell nothing more
        for e in page.elements:
            words = page.words[e.end] - page.words[e.first]
            share = (main[e.end] - main[e.first]) / words if words else 0.0
            held = e.up >= 0 and inside[e.up]
            names = names_of(e.raw)
            inside.append(held or (share > 0.9 and e.tag in ("article", "main", "div", "section") and bool(names or e.tag in ("article", "main"))))
            beyond = e.up >= 0 and outside[e.up]
            outside.append(beyond or (share < 0.5 and e.tag not in ("html", "body")))
            if not words or beyond or e.tag in ("html", "body"):
                continue
            (yes if share >= 0.5 else no).update([f"<{e.tag} in" if held else f"<{e.tag}"])
            of = names_yes if share >= 0.5 else names_no
            of.update("." + x for x in names)
            of.update("-" + p for x in names if ":" not in x for p in _PARTS.findall(x))
            if names:
                (yes if share >= 0.5 else no).update(page.features(e))
    features = _odds(yes, no) | _odds(names_yes, names_no)
    out = Model(features, {"<>": 0.0})
    yes, no = Counter(), Counter()
    for page, ranges in pages:
        first, end = ranges[0][0], ranges[-1][1]
        at = -1
        for x, kind in zip(page.items, tokens_of(page, out.furniture(page)), strict=True):
            at = at if isinstance(x, int) else x.at  # a tag stands where the text before it does
            if kind:
                (yes if first <= at < end else no)[kind] += 1 if isinstance(x, int) else x.words
    tokens = _odds(yes, no)
    tokens["<>"] = -0.5
    out.tokens = {k: max(v, 0.5) if k in ("#w", "#h") else min(v, 0.1) if k == "#a" else max(min(v, -0.1), -2.0) for k, v in tokens.items()}
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, end) of the contiguous part of the highest sum; the earliest and longest of equals; (0, 0) if none is
    positive."""
    best, where, total, first = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, k
        total += s
        if total > best or (total == best and where[0] == first and best):
            best, where = total, (first, k + 1)
    return where


def main_text(page: str | None) -> str:
    """The main text of a page; "" for null, for empty pages and for those without words outside furniture.

    White space in a block becomes one blank; blocks are joined by a line feed. Time and memory grow in proportion to
    the page, whatever its tags.
    """
    if not page:
        return ""
    m, p = model(), Page(page)
    kinds = tokens_of(p, m.furniture(p))
    scores = [0.0 if not k else m.weight(k) if isinstance(x, int) else m.weight(k) * x.words for x, k in zip(p.items, kinds, strict=True)]
    first, end = best_region(scores)
    if first == end:
        return ""
    texts = [x for x, k in zip(p.items, kinds, strict=True) if k and not isinstance(x, int)]
    of = {x.block for x in p.items[first:end] if not isinstance(x, int)}
    lowest, highest = min(of), max(of)
    headings: set[int] = set()
    for x in reversed(texts):  # headings right before the region
        if x.block >= lowest or not x.words:
            continue
        if x.kind != "#h":
            break
        headings.add(x.block)
    blocks: dict[int, list[str]] = {}
    for x in texts:
        if lowest <= x.block <= highest or x.block in headings:
            blocks.setdefault(x.block, []).append(x.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    Null html counts as empty and gives an empty text; ids and urls pass through, null or not; repeated rows are
    extracted each; other columns are ignored; an empty table gives no rows. Of two regions of the same sum the earlier
    is taken. A very long page takes time and memory in proportion to its length. No shuffle.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "html"):
            found = [main_text(p) for p in texts_of(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(run, SCHEMA)
