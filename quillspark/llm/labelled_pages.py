"""Labelled pages from which extraction learns its weights: several hundred pages drawn from a rule.

A page is built from parts that each know whether they belong to the main text. The rule mixes layouts (wrappers, one
or several articles, tables, flat pages, pages without any names), text-level markup, furniture around, between and
inside the articles, and names of classes as authors give them, so that no single name decides alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Tags and names of furniture by its kind.
FURNITURE = {
    "links": ("nav ul div section menu header", "nav navbar menu main-menu navigation site-nav top-nav breadcrumb breadcrumbs pagination pager toolbar skip sidenav"),
    "head": ("header header div", "header site-header masthead page-header top-bar topbar banner brand"),
    "foot": ("footer footer div section", "footer site-footer page-footer copyright legal disclaimer bottom colophon"),
    "side": ("aside aside div section", "sidebar side-bar widget widgets rail secondary complementary"),
    "ad": ("div div aside section", "ad ads advert advertisement ad-slot ad-box sponsor sponsored promo promotion banner-ad outbrain taboola"),
    "notice": ("div div section dialog", "cookie cookies cookie-notice cookie-banner consent gdpr notice site-notice alert popup modal overlay"),
    "comments": ("section div ol", "comments comment comment-list commentlist disqus respond replies discussion reader-comments"),
    "form": ("form form div fieldset", "newsletter subscribe subscription signup login search search-form contact-form"),
    "share": ("div ul button select", "share sharing social social-links share-buttons follow print-only"),
    "related": ("aside section div ul", "related related-posts recommended recommendations read-more more-stories popular trending teaser teasers tags tag-list meta-bar"),
}
ROLES = {"links": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "form": "search", "notice": "alertdialog"}
#: Names of what holds the main text, of wrappers, and what stands beside names of articles.
CONTENT = "article post entry hentry entry-content post-content post-body content main-content page-content story story-body article-body body-text prose text".split()
WRAPPERS = "container wrapper page site layout inner row col main-column has-sidebar with-menu no-footer grid theme-light".split()
BESIDE = "category-news category-social tag-legal tag-ads format-standard status-publish type-post post-17 featured sticky has-comments notice-board".split()

Part = tuple[str, bool]


class Author:
    """Draws the parts of pages."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def some(self, text: str) -> str:
        return self.rng.choice(text.split())

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        draw = lambda: "".join(self.rng.choice("bdfklmnrst") + self.rng.choice("aeiou") for _ in range(self.rng.randrange(1, 4)))
        return " ".join(draw() for _ in range(self.rng.randrange(low, high)))

    def inline(self, low: int, high: int) -> str:
        t = self.words(low, high)
        for mark in ("b", "em", 'a href="x"', "span", "label", "code", "button"):
            if self.chance(0.15):
                t += f" <{mark}>{self.words(1, 4)}</{mark.split()[0]}> {self.words(2, 9)}"
        return t + ("<br>" + self.words(2, 9) if self.chance(0.1) else "")

    def prose(self) -> str:
        """Blocks of a main text, a heading first in most."""
        out = [f"<h1>{self.words(1, 9)}</h1>"] if self.chance(0.8) else []
        for _ in range(self.rng.randrange(1, 9)):
            kind = self.rng.random()
            if kind < 0.7:
                out.append(f"<p>{self.inline(1, 60)}." + ("</p>" if self.chance(0.9) else ""))
            elif kind < 0.78:
                out.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.inline(1, 12)}</li>" for _ in range(self.rng.randrange(1, 6))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{self.words(4, 30)}</p></blockquote>")
            elif kind < 0.94:
                out.append(f'<figure><img src="i"><figcaption>{self.words(2, 12)}</figcaption></figure>')
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<div>{self.inline(5, 40)}</div>")
        return "".join(out)

    def links(self) -> str:
        n = self.rng.randrange(1, 12)
        item = lambda: f'<a href="/x">{self.words(1, 5)}</a>'
        return self.rng.choice([lambda: "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>", lambda: " | ".join(item() for _ in range(n)), lambda: "".join(f"<div>{item()}</div>" for _ in range(n))])()

    def furniture(self, kind: str, named: float = 0.85) -> str:
        tags, names = FURNITURE[kind]
        tag = self.some(tags)
        if kind == "comments":
            one = lambda: f'<{self.rng.choice(["li", "article", "div"])} class="comment"><p>{self.inline(2, 40)}</p></div>'
            body = f"<h3>{self.words(1, 4)}</h3>" + "".join(one() for _ in range(self.rng.randrange(1, 6)))
        elif kind in ("links", "share", "related", "side", "head"):
            body = (f"<h3>{self.words(1, 4)}</h3>" if self.chance(0.4) else "") + self.links() + (f"<p>{self.words(3, 20)}</p>" if self.chance(0.3) else "")
        elif kind == "form":
            body = f"<label>{self.words(1, 4)}</label><input><select><option>{self.words(1, 3)}</option></select><button>{self.words(1, 3)}</button>"
        else:
            body = self.rng.choice([self.words(2, 25), f"<p>{self.words(2, 25)}</p>", f'<p>{self.words(2, 12)} <a href="x">{self.words(1, 4)}</a></p>', f"<p>{self.words(2, 9)}</p><button>{self.words(1, 3)}</button>"])
        attributes = ""
        if self.chance(named) or tag in ("div", "section", "ul", "ol"):
            attributes = f' {self.rng.choice(["class", "class", "id"])}="{self.some(names)}"'
        if kind in ROLES and self.chance(0.15):
            attributes += f' role="{ROLES[kind]}"'
        if self.chance(0.03):
            attributes += self.rng.choice([" hidden", ' aria-hidden="true"', ' style="display: none"'])
        return f"<{tag}{attributes}>{body}</{tag}>"

    def unmarked(self) -> str:
        """Furniture that nothing names."""
        return self.rng.choice([lambda: f"<p>{self.links()}</p>", lambda: f"<div>{self.links()}</div>", lambda: f"<p>&copy; {self.words(1, 6)}</p>", lambda: f"<div><a href=x>{self.words(1, 4)}</a></div>"])()

    def article(self) -> Iterator[Part]:
        """A main text in its element, with furniture inside in some."""
        tag = self.rng.choice(["article", "article", "main", "div", "div", "section"])
        names = self.rng.sample(BESIDE, self.rng.randrange(3)) if tag == "article" else []
        if tag in ("div", "section") or self.chance(0.4):
            names = [self.rng.choice(CONTENT), *names]
        yield f"<{tag}" + (f' {self.rng.choice(["class", "class", "id"])}="{" ".join(names)}"' if names else "") + ">", True
        if self.chance(0.15):
            yield f"<header><h1>{self.words(1, 8)}</h1>" + (f"<p>{self.words(2, 9)}</p>" if self.chance(0.5) else "") + "</header>", True
        if self.chance(0.25):
            yield self.furniture(self.rng.choice(["share", "ad", "notice", "links"])), False
        yield self.prose(), True
        if self.chance(0.3):
            yield self.furniture(self.rng.choice(["ad", "related", "share", "form"])), False
            yield self.prose(), True
        if self.chance(0.1):
            yield f"<footer><p>{self.words(3, 14)}</p></footer>", False
        yield f"</{tag}>", True

    def page(self) -> list[Part]:
        around = lambda kinds, p: [(self.furniture(k), False) for k in kinds if self.chance(p)]
        plain = lambda p: [(self.unmarked(), False)] if self.chance(p) else []
        out: list[Part] = [(f"<html><head><title>{self.words(2, 6)}</title></head><body>", False)]
        wrappers = self.rng.randrange(3)
        out += [(f'<div class="{" ".join(self.rng.sample(WRAPPERS, self.rng.randrange(1, 3)))}">', False) for _ in range(wrappers)]
        out += around(["notice", "head", "links", "form", "ad"], 0.45) + plain(0.25)
        if self.chance(0.2):  # no element of its own
            cell = self.chance(0.3)
            out += [("<table><tr><td>" + self.links() + "</td><td>" if cell else "<div>", False), (self.prose(), True), ("</td></tr></table>" if cell else "</div>", False)]
        else:
            for k in range(1 + self.chance(0.15)):
                out += around(["ad", "links"], 0.3) if k else []
                out += self.article()
        out += plain(0.25) + around(["share", "related", "side", "comments", "ad", "form", "foot"], 0.45) + plain(0.3)
        return [*out, ("</div>" * wrappers + "</body></html>", False)]


def labelled(count: int = 400, seed: int = 20) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(page, ranges): pages and the ranges of their characters that belong to the main text."""
    for k in range(count):
        page, ranges = "", []
        for text, is_main in Author(seed * 100_000 + k).page():
            if is_main:
                ranges.append((len(page), len(page) + len(text)))
            page += text
        yield page, ranges
