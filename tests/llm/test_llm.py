"""The training-data operators against brute force, and on odd inputs."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, components, extraction, merging, packing, resampling, rules, simhash, token_counts, topk, toxicity, warc

SPACE = "[^\x20\x09-\x0d]+"
WORD_BPE, BYTE_BPE, RANKS = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp int, row string, m int, word string, key double"


def make_texts():
    rng = random.Random(7)
    vocab = ["the", "Ring", "of", "überall", "niño", "x1", "don't", "I'll", "12,5", "#tag", "日本語", "a" * 40, "…", " ", "é", "ǅ", "ſ", "<|endoftext|>", "😀"]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    out += ["", None, " ", "\n\n", "a", "one two", "tab\tand  two   blanks \n", "x" * 3000, "ab" * 2500, "lines\nlines\nlines\n", " lead", "trail ", "\x1c\x1d", "A B", "\r\n"]
    out += ["same words again and again " * 40] * 3 + ["long text of words " * 6000]
    return out


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "x", i, "r", 1, "w", 0.5) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "no id here", None, None, 1, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0), "extra") for i in range(40)] + [(None, 1, 1, ""), (3, None, None, ""), (10**6, 1, 0, "")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def by_id(df, *cols):
    """A document's row; repeated rows must be alike."""
    out = {}
    for r in df.collect():
        v = tuple(r[c] for c in cols)
        assert out.setdefault(r.doc_id, v) == v
    return out


# ---- 1


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><header><h2>Site</h2></header>"
    '<div class="cookie-notice">Cookies!</div><article><header><h1>Big &amp; small</h1></header><p>First   <b>bold</b>\n text<br>here.<p>Second &lt;p&gt; one'
    '<script>var a="</p>";</script><aside>Read more</aside><ul><li>item one<li>item two</ul><div class="ad">Buy</div></article><!-- <p>no</p> -->'
    '<div class="comments"><p>nice post</p></div><form><input>Name</form><footer>&copy; me</footer></body></html>'
)


def test_extraction(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>only a paragraph"), (5, "u", "no tags &eacute;"), (6, "u", "<div <p"), (7, "u", "<b>" * 5000), (1, "u", PAGE), (None, "u", "<main>x</main>")]
    d = spark.createDataFrame([(*p, 1, "t") for p in pages], "page_id long, url string, html string, n_chars int, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.extract(d).collect()}
    want = "Big & small\nFirst bold text here.\nSecond <p> one\nitem one\nitem two"
    assert got[1] == (want, len(want))
    assert got[2] == got[3] == ("", 0) and got[4][0] == "only a paragraph" and got[5][0] == "no tags é" and got[None][0] == "x"
    assert extraction.extract(d).count() == len(pages) and extraction.extract(d.limit(0)).count() == 0


def test_extraction_keeps_all_blocks_of_an_article():
    w = " ".join(f"word{i} goes on" for i in range(20))
    body = lambda t: f'<div class="article-body"><p>{t} {w}</p></div>'
    two = f'<body><nav><a href=x>Home</a></nav>{body("First")}<div class="ad">Buy</div>{body("Second")}<footer>f</footer></body>'
    assert extraction.main_text(two) == f"First {w}\nSecond {w}"
    apart = f'<body>{body("First")}<ul class="menu">{"<li><a href=x>link</a></li>" * 80}</ul>{body(f"Second {w}")}</body>'
    assert extraction.main_text(apart) == f"First {w}\nSecond {w} {w}"
    box = f'<body><nav><a href=x>Home</a></nav><div><p>Before {w}</p><div class="story"><p>A small box.</p></div><p>After {w}</p></div></body>'
    assert extraction.main_text(box) == f"Before {w}\nA small box.\nAfter {w}"


def words_of(pages):
    """Words found and words wanted of held-out labelled pages."""
    import html
    from collections import Counter

    for page, ranges in pages:
        main = "".join(page[a:b] for a, b in ranges)
        yield page, Counter(extraction.main_text(page).split()), Counter(html.unescape(re.sub("<[^>]*>", " ", main)).split())


def test_extraction_of_held_out_pages(monkeypatch):
    from quillspark.llm.labelled_pages import labelled

    pages = list(labelled(150, 77))
    found = list(words_of(pages))
    both, got, want = (sum(sum(x.values()) for x in c) for c in ([f & w for _, f, w in found], [f for _, f, _ in found], [w for _, _, w in found]))
    assert both / got > 0.97 and both / want > 0.99
    for page, _ in pages[:40]:  # the whole operator against all regions, one by one
        p, m = extraction.Page(page), extraction.model()
        kinds = extraction.tokens_of(p, m.furniture(p))
        upto = np.cumsum([0.0, *(0.0 if not k else m.weight(k) * (1 if isinstance(x, int) else x.words) for x, k in zip(p.items, kinds))])
        gain = np.triu(upto[None, :] - upto[:, None], 1)
        a, b = extraction.best_region(np.diff(upto).tolist())
        assert gain[a, b] == pytest.approx(gain.max())
        blocks = {x.block for x in p.items[a:b] if not isinstance(x, int)}
        lines = {}
        for x, k in zip(p.items, kinds):
            if k and not isinstance(x, int) and min(blocks) <= x.block <= max(blocks):
                lines[x.block] = lines.get(x.block, "") + x.text
        body = "\n".join(t for t in (" ".join(v.split()) for v in lines.values()) if t)
        assert extraction.main_text(page).endswith(body)
    texts = [extraction.main_text(p) for p, _ in pages]
    for instead in (lambda s: (0, len(s)), lambda s: next(((k, k + 1) for k, v in enumerate(s) if v > 0), (0, 0))):
        monkeypatch.setattr(extraction, "best_region", instead)
        assert sum(extraction.main_text(p) != t for (p, _), t in zip(pages, texts)) > 50  # the scan decides


def test_extraction_of_odd_pages():
    import time

    for small, large in (("<div>" * 4000 + "</i>" * 4000, "<div>" * 32000 + "</i>" * 32000), ("<main>a " * 4000, "<main>a " * 32000), ("<a \"" * 4000, "<a \"" * 32000), ("<p class='" + "a-" * 9000 + "'>x", "<p class='" + "a-" * 72000 + "'>x")):
        took = []
        for p in (small, large):
            began = time.process_time()
            extraction.main_text(p)
            took.append(time.process_time() - began)
        assert took[1] < 30 * took[0] + 0.5  # eight times the page
    t = extraction.main_text
    assert t('<article class="post category-social tag-legal"><h1>T</h1><p>Some words in it.</p></article>') == "T\nSome words in it."
    assert t('<main id="legal"><p>Some words in it.</p></main>') == "Some words in it."
    assert t("<article><p>Name the <label>field</label> and press <button>go</button> now.</p></article>") == "Name the field and press go now."
    assert t("<nav><a>x</a></nav><article><p>One article.</p></article><article><p>Two article.</p></article>") == "One article.\nTwo article."
    board = '<div class="notice-board"><p>' + "Prose in a board of notices goes on. " * 3 + "</p></div>"
    assert t(f"<article><p>Words before it.</p>{board}</article>").startswith("Words before it.\nProse in a board")
    assert t("<p>same words</p>" + "<nav>x</nav><div>" * 9 + "<p>same words</p>") == "same words"  # equal sums: the first


def test_best_region():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(-5, 6) for _ in range(rng.randrange(12))]
        a, b = extraction.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


# ---- 2


def pages_for(spark):
    rows = [(1, "http://a/ b", "x"), (2, None, "y"), (3, "u", "x"), (4, "u", None), (5, "u", ""), (6, "u", "ü" * 70000), (7, "u", "x"), (7, "u", "x"), (None, "u", "x")]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers_to string")


def test_warc_round_trip(spark):
    got = sorted(warc.round_trip(pages_for(spark)).collect(), key=lambda r: (r.page_id is None, r.page_id))
    want = {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("revisit", 4), 6: ("response", None), 7: ("revisit", 1), None: ("response", None)}
    assert len(got) == 9 and all((r.record_type, r.refers_to) == want[r.page_id] for r in got)
    sizes = {r.page_id: r.payload_bytes for r in got}
    assert sizes[6] == 140000 and sizes[3] == 1 and sizes[5] == 0
    assert all(r.payload_digest == warc.digest({1: b"x", 2: b"y", 3: b"x", 4: b"", 5: b"", 6: "ü".encode() * 70000, 7: b"x", None: b"x"}[r.page_id]) for r in got)
    assert {r.page_id for r in warc.round_trip(pages_for(spark), 1).where("record_type = 'revisit'").collect()} == {3, 7}
    assert warc.round_trip(pages_for(spark).limit(0)).count() == 0


def test_warc_of_repeated_ids(spark):
    d = spark.createDataFrame([(1, "u", "x"), (2, "u", "y"), (5, "u", "x"), (5, "u", "own"), (6, "u", "x"), (6, "u", "y")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(d).collect())
    x, y, own = (warc.digest(c) for c in (b"x", b"y", b"own"))
    want = [(1, x, "response", None), (2, y, "response", None), (5, x, "revisit", 1), (5, own, "response", None), (6, x, "revisit", 1), (6, y, "revisit", 2)]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(spark, tmp_path, packed):
    rng = random.Random(3)
    wrap = warc.member if packed else lambda x: x
    parts = [wrap(warc.record(i, "u", bytes(rng.randrange(256) for _ in range(rng.randrange(4000))) + b"WARC/1.0\r\n\x1f\x8b\x08")) for i in range(30)]
    starts = np.cumsum([0, *map(len, parts)])
    data = bytearray(b"".join(parts))
    for i in (0, 7, 8, 20):  # bytes changed inside, and a member's magic
        data[starts[i] + len(parts[i]) // 2] ^= 0xFF
    data[starts[12]] ^= 0xFF
    data = bytes(data[: starts[25] + 5]) + bytes(data[starts[26] :])  # a record that breaks off
    data = data[:-7]  # and the file does
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "c.warc").write_bytes(b"nothing of the kind" * 100)
    f = spark.createDataFrame([(str(tmp_path / x),) for x in ("a.warc", "b.warc", "c.warc", "a.warc")], "path string")
    got = warc.read(f).orderBy("path", "start").collect()
    a = [r for r in got if r.path.endswith("a.warc")]
    assert {int(r.record_id.rpartition(":")[2]) for r in a if r.kind == "record"} == set(range(30)) - {0, 7, 8, 12, 20, 25, 29}
    assert a[0].start == 0 and a[-1].stop == len(data) and all(x.stop == y.start for x, y in zip(a, a[1:], strict=False))
    assert [(r.start, r.stop) for r in a if r.kind == "gap"][:2] == [(0, starts[1]), (starts[7], starts[9])] and all(r.reason for r in a if r.kind == "gap")
    assert [(r.kind, r.stop) for r in got if r.path.endswith("c.warc")] == [("gap", 1900)] and not any(r.path.endswith("b.warc") for r in got)


def test_warc_of_odd_files(spark, tmp_path):
    long_head = warc.record(1, "u", b"x").replace(b"\r\nWARC-Date", b"\r\nX-Long: " + b"y" * (3 << 20) + b"\r\nWARC-Date", 1)
    odd = warc.record(2, "u", b"x", 1, warc.digest(b"x"))
    block = odd.split(b"\r\n\r\n", 1)[1][:-4]
    new = block.replace(b"Content-Length: 1", b"Content-Length: abc")
    odd = odd.replace(block, new).replace(warc.digest(block).encode(), warc.digest(new).encode()).replace(b"Content-Length: %d\r\n" % len(block), b"Content-Length: %d\r\n" % len(new), 1)
    big = bytes(random.Random(1).randrange(256) for _ in range(1000)) * 3000
    versions = b"WARC/1.0\r\n" * 100_000  # begins of records that never end
    files = {
        "plain": long_head + odd + versions + warc.record(3, None, big), "packed": warc.member(long_head) + warc.member(odd) + warc.member(warc.record(3, None, big)),
        "more": warc.member(warc.record(4, "u", b"y") + b"more than it says" * 10**6) + warc.member(warc.record(5, "u", b"z")),
    }
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    f = spark.createDataFrame([(str(tmp_path / x),) for x in (*files, "missing")], "path string")
    for payload in (True, False):
        got = {}
        for r in warc.read(f, payload).orderBy("path", "start").collect():
            got.setdefault(r.path.rpartition("/")[2], []).append((r.kind, (r.record_id or "")[-1:], r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)))
        kept = lambda x: x if payload else None
        first, second, third = ("record", "1", 1, warc.digest(b"x"), kept(b"x")), ("record", "2", None, warc.digest(b"x"), kept(b"")), ("record", "3", len(big), warc.digest(big), kept(big))
        assert got["packed"] == [first, second, third] and got["plain"][:2] == [first, second] and got["plain"][-1] == third
        assert [x[0] for x in got["plain"]] == ["record", "record", "gap", "record"] and [x[:2] for x in got["more"]] == [("gap", ""), ("record", "5")]
        assert got["missing"] == [("gap", "", None, None, None)]


def test_warc_is_read_by_many_tasks(spark, tmp_path):
    for i in range(8):
        (tmp_path / f"{i}.warc.gz").write_bytes(warc.member(warc.record(i, "u", b"x" * i)))
    f = spark.createDataFrame([(str(tmp_path / f"{i}.warc.gz"),) for i in range(8)], "path string")
    out = warc.read(f, False).withColumn("task", F.spark_partition_id())
    assert out.count() == 8 and out.select("task").distinct().count() > 1


# ---- 3, 4, 8


def test_byte_bpe(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.encode(docs, RANKS, P.PATTERN, 20), "ids", "decoded")
    for i, t in enumerate(TEXTS):
        assert got[i] == (lib.encode_ordinary(t or ""), (t or "").encode()), t
    dig = by_id(byte_bpe.digests(docs, RANKS, P.PATTERN), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in enumerate(TEXTS):
        ids = lib.encode_ordinary(t or "")
        assert dig[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert byte_bpe.digests(docs, RANKS, P.PATTERN).count() == docs.count() and byte_bpe.digests(empty, RANKS, P.PATTERN).count() == 0


def test_byte_bpe_of_long_words(spark, monkeypatch):
    import tiktoken

    monkeypatch.setattr(byte_bpe, "LONG_WORD", 12)  # the way of long words, on words that brute force can do
    ranks = byte_bpe.ranks_of(RANKS)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    words = ["a" * n for n in range(1, 40)] + ["".join(rng.choice("aabins") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    coder = byte_bpe.Coder(RANKS, P.PATTERN)
    got = d.select("w", coder.tables(spark).alias("t")).select("w", coder.fold(F.col("w"), F.col("t")).alias("ids")).collect()
    for r in got:
        assert r.ids == " ".join(map(str, lib.encode_ordinary(r.w))), r.w


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(TEXTS)}
    out = token_counts.token_counts(docs, BYTE_BPE, P.PATTERN)
    got = by_id(out, "n_bytes", "n_tokens", "over_limit")
    for i, x in enumerate(TEXTS):
        assert got[i] == (len((x or "").encode()), want[i], want[i] > 512), x
    assert out.count() == docs.count() and token_counts.token_counts(empty, BYTE_BPE, P.PATTERN).count() == 0


def test_merging_equals_one_at_a_time():
    table, rng = merging.MergeTable(BYTE_BPE), random.Random(6)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE_BPE)
    words = ["".join(rng.choice("aaabeinst") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    counts, ids = table.merge([w.encode() for w in words])
    want = [lib.encode(w, add_special_tokens=False).ids for w in words]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_packing_ids_equal_the_library():
    """Batches split and merged in arrays give the library's ids, for odd characters, long runs and special strings too."""
    from tokenizers import Tokenizer

    coder = packing.BatchCoder(WORD_BPE, part=7)
    library = Tokenizer.from_file(WORD_BPE)
    r = random.Random(3)
    letters = [*"abcABC019 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u3000\u200b'\"!?.-_éÉßİſKÅ中文🙂\u0301\x00\x7f", "'s", "'re", "'LL", "don't", "</w>", "the", *coder.table.specials]
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(4000)] + ["", None, " ", "a" * 30_000, "'" * 500, "1" * 300]
    for some in (texts, [], [None], ["'"], ["\n"]):
        ids, counts = coder.encode(pa.array(some, pa.string()))
        ends = counts.cumsum()
        assert len(counts) == len(some) and counts.sum() == len(ids)
        for text, n, end in zip(some, counts.tolist(), ends.tolist(), strict=True):
            assert ids[end - n : end].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(TEXTS)}
    d = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    for window in (3000, 1 << 21):
        rows = packing.pack(d, WORD_BPE, window_tokens=window).collect()
        seqs, of = {}, {}
        for r in rows:
            seqs.setdefault(r.sequence_id, []).append(r)
            of.setdefault(r.doc_id, []).append(r)
            piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
            assert r.length > 0 and r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids[r.doc_id])
        for i, pieces in of.items():
            pieces.sort(key=lambda r: r.start)
            assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()] and sum(p.length for p in pieces) == len(ids[i])
        assert of.keys() == ids.keys()
        padding = 0
        for s in seqs.values():
            s.sort(key=lambda r: r.offset)
            n = sum(p.length for p in s)
            assert n <= 2048 and [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1].tolist()]
            padding += 0 if n & (n - 1) == 0 else 2048 - n
        assert padding <= 0.02 * sum(map(len, ids.values()))
    assert packing.pack(docs, WORD_BPE).groupBy("doc_id").agg(F.sum("length")).where("doc_id is null").count() == 1 and packing.pack(empty, WORD_BPE).count() == 0


# ---- 5, 9


def corpus(spark, n=600):
    rng = random.Random(8)
    good, bad = [f"w{i}ord" for i in range(150)], [f"zz{i}junk" for i in range(150)]
    good, bad = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in good], ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in bad]
    rows, lab = [], []
    for i in range(n):
        q = rng.random() < 0.75
        toxic = rng.random() < 0.25
        words = [rng.choice(good if q else bad) for _ in range(60)] + (["you", "vilefool", "stupidest"] * 2 if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s"))
        if i % 2:
            lab.append((i, int(q), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d, spark.createDataFrame(lab, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in lab}


def test_resampling(spark, docs, labels, empty):
    d, lab, truth = corpus(spark)
    out = resampling.resample(d, lab)
    got = by_id(out, "kept")
    assert np.mean([got[i][0] == bool(q) for i, (q, _) in truth.items()]) > 0.95
    share = np.mean([q for q, _ in truth.values()])
    assert sum(v[0] for v in got.values()) == -(-share * 600 // 1)
    rows = sorted(((r.key, r.kept) for r in out.collect()), reverse=True)
    assert all(k for _, k in rows[: int(sum(v[0] for v in got.values()))])  # the kept keys are the highest
    assert resampling.resample(docs, labels).count() == docs.count() and resampling.resample(empty, labels).count() == 0
    assert resampling.resample(docs, labels.limit(0)).where("kept").count() == docs.count()
    kept = resampling.keep_resampled(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in resampling.resample(docs, labels).where("kept").collect()}


def test_resampling_against_brute_force(spark):
    """Log ratios, noise and the number drawn, recomputed one text at a time."""
    import math
    import struct

    import xxhash

    d, lab, truth = corpus(spark, 120)
    texts = {r.doc_id: r.text for r in d.collect()}
    top = 1 << 16

    def grams_of(text):
        h = [xxhash.xxh64_intdigest(r) for c in text.split() for r in re.findall(r"[^\W\d_]+|[\W\d_]+", c)]
        odd, cut = 0x9E3779B97F4A7C15, (1 << 64) - 1
        return [("1", x >> 48) for x in h] + [("2", (((a * odd & cut) ^ b) * odd & cut) >> 48) for a, b in zip(h, h[1:], strict=False)]

    raw, target = {}, {}
    for i, t in texts.items():
        for g in grams_of(t):
            raw[g] = raw.get(g, 0) + 1
            if truth.get(i, (0, 0))[0]:
                target[g] = target.get(g, 0) + 1
    scale = {k: sum(n for g, n in target.items() if g[0] == k) / sum(n for g, n in raw.items() if g[0] == k) for k in "12"}
    assert all(0 <= g[1] < top for g in raw)
    want = {}
    for i, t in texts.items():
        ratio = sum(math.log(target.get(g, 0) + 4.0) - math.log(raw[g] * scale[g[0]] + 4.0) for g in grams_of(t))
        h = xxhash.xxh64_intdigest(struct.pack("<i", 5), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
        want[i] = ratio, ratio - math.log(-math.log((h % (1 << 52) + 0.5) / (1 << 52)))
    got = by_id(resampling.resample(d, lab), "log_ratio", "key", "kept")
    assert all(got[i][:2] == pytest.approx(want[i], abs=1e-3) for i in want)
    k = math.ceil(np.mean([q for q, _ in truth.values()]) * len(texts))
    assert {i for i in got if got[i][2]} == set(sorted(want, key=lambda i: -want[i][1])[:k])


def test_kth_largest(spark):
    rng = random.Random(9)
    x = [round(rng.gauss(0, 50), 1) for _ in range(3000)] + [7.5] * 500
    d = spark.createDataFrame([(v,) for v in x], "v double").cache()
    for k in (1, 2, 17, 1500, 3499, 3500):
        assert d.where(F.col("v") >= resampling.kth_largest(d, "v", k)).count() >= k > d.where(F.col("v") > resampling.kth_largest(d, "v", k)).count() or k >= len(x)


def test_toxicity(spark, docs, labels, empty):
    d, lab, truth = corpus(spark, 900)
    got = by_id(toxicity.toxicity(d, lab), "held_out", "score", "predicted")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == int(s >= 0.5) for i, (h, s, p) in got.items())
    held = [(got[i][2], t) for i, (_, t) in truth.items() if got[i][0]]
    assert np.mean([p == t for p, t in held]) > 0.9
    out = toxicity.toxicity(docs, labels)
    assert out.count() == docs.count() and toxicity.toxicity(empty, labels).count() == 0 and out.where("score is null or held_out is null").count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()


def test_isotonic():
    x, y = np.array([3.0, 1.0, 2.0, 4.0, 2.0]), np.array([1.0, 0.0, 1.0, 0.0, 0.0])
    knots, p = toxicity.isotonic(x, y)
    assert (np.diff(p) > 0).all() and p[0] == 0.0 and p[-1] == pytest.approx(0.5) and (np.diff(knots) > 0).all()


# ---- 6


def brute_fingerprint(text):
    import xxhash

    w = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: id to fingerprint; the smallest id reachable over links of at most three bits."""
    names, out = sorted(fps), {}
    for i in names:
        if i in out:
            continue
        todo = [i]
        out[i] = i
        while todo:
            a = todo.pop()
            for b in names:
                if b not in out and (fps[a] ^ fps[b]).bit_count() <= 3:
                    out[b] = i
                    todo.append(b)
    return out


def test_simhash(docs, empty):
    got = by_id(simhash.near_duplicates(docs), "fingerprint", "component_id")
    fps = {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}
    assert {i: int(got[i][0], 16) for i in fps} == fps
    want = brute_components(fps)
    assert {i: got[i][1] for i in fps} == want
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(empty).count() == 0
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted({*want.values()})


def test_one_row_of_every_component_with_repeated_ids(spark):
    w = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    d = spark.createDataFrame([(1, w["a"]), (2, w["a"]), (2, w["b"]), (3, w["b"]), (4, w["c"]), (4, w["d"]), (4, w["d"]), (4, w["d"].upper()), (None, w["a"])], "doc_id long, text string")
    got = [(r.doc_id, (r.text or "").lower()) for r in simhash.drop_near_duplicates(d).collect()]
    assert sorted(got, key=str) == sorted([(1, w["a"]), (2, w["b"]), (4, w["c"]), (4, w["d"]), (None, w["a"])], key=str)


def test_links_of_random_fingerprints(spark):
    rng = random.Random(10)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    d = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    star = {r.x: r.y for r in components.components(simhash.links(d)).collect()}
    roots = {}
    for x, name in brute_components(dict(enumerate(fps))).items():
        s = fps[x] - (1 << 64) if fps[x] >> 63 else fps[x]
        roots.setdefault(name, set()).add(star.get(s, s))
    assert all(len(v) == 1 for v in roots.values()) and len({next(iter(v)) for v in roots.values()}) == len(roots)


def test_large_group_of_links():
    rng = np.random.default_rng(11)
    low, n = simhash.BLOCKS[0]
    fps = np.unique(rng.integers(0, 1 << n, 400).astype(np.uint64) << np.uint64(low) | np.uint64(5) << np.uint64(50))
    links = simhash.group_links(fps, simhash.BLOCKS[0])
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 3 for a, b in links)
    forest = simhash.Forest()
    for a, b in links:
        forest.join(a, b)
    want = brute_components({i: int(x) for i, x in enumerate(fps)})
    groups = {}
    for i, w in want.items():
        groups.setdefault(w, set()).add(forest.root(i))
    assert all(len(g) == 1 for g in groups.values())


def test_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)] + [(2000, 2000 + i) for i in range(300)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.x: r.y for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] is not None for x in e if root(x) != x}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


# ---- 7


def test_top_k(spark):
    rng = np.random.default_rng(13)
    m = rng.normal(size=(1500, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[100:160] = m[50]  # ties
    rows = [(int(i) * 2, x.tolist()) for i, x in enumerate(m)]
    odd = [(7, None), (9, [None] * 8), (11, [float("nan")] * 8), (13, [float("inf")] * 8), (None, [1.0] * 8), (15, [0.5])]
    v = spark.createDataFrame([(*r, "s") for r in [*rows, *odd]], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(v).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([r[0] for r in rows] + [15])
    x = np.floor(256 * np.vstack([m, [[0.5] + [0.0] * 7]])).astype(np.int64)
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:5]
        want[int(ids[q])] = [(k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order)]
    assert got == want
    few = topk.top_k(v.where("vec_id < 5")).collect()
    assert [(r.query_id, r.rank) for r in sorted(few)] == [(0, 1), (0, 2)]
    assert topk.top_k(v.limit(0)).count() == 0
    twice = topk.top_k(v.where("vec_id < 5").union(v.where("vec_id < 5"))).orderBy("rank").collect()
    assert [r.vec_id for r in twice] == sorted([2, 2, 4, 4], key=lambda i: (-int(x[i // 2] @ x[0]), i))


def test_queries_visit_parts_that_can_hold_more(spark, monkeypatch):
    """Clustered vectors: the same results as over all pairs, and few copies of queries."""
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(24, 6)) * 4
    m = np.repeat(centres, 60, axis=0) + rng.normal(size=(1440, 6)) * 0.05
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>").coalesce(1)
    made = []

    plain = topk.routed
    monkeypatch.setattr(topk, "routed", lambda e, c: made.append((topk.materialize(plain(e, c), "routed"), e.count(), c.agg(F.sum("size")).first()[0])) or made[-1][0])
    got = {}
    for r in topk.top_k(v, 5, 20, 30, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = np.floor(256 * m).astype(np.int64)
    for q in range(0, 1440, 20):
        s = x @ x[q]
        assert got[q] == [(int(j), int(s[j])) for j in np.lexsort((np.arange(1440), -s)) if j != q][:5]
    away, parts, queries = made[0]
    copies = away.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    assert parts >= 20 and queries == 72 and copies < queries * parts / 4


def test_blocks_are_pruned():
    q = np.array([[10.0, 0.0]])
    blocks = [topk.Block(2, 2, np.array([2 * k, 2 * k + 1]).tobytes(), np.array([[k, 1.0], [k, 2.0]]).tobytes(), np.array([k, 2.0]).tobytes(), np.array([k, 1.0]).tobytes()) for k in range(20)]
    qi, vi, s, scored = topk.search(blocks, np.array([-1]), q, np.array([-np.inf]), 2)
    assert vi.tolist() == [38, 39] and s.tolist() == [190, 190] and scored == 1
    huge = topk.Block(1, 1, np.array([1]).tobytes(), np.array([[2.0**40]]).tobytes(), np.array([2.0**40]).tobytes(), np.array([2.0**40]).tobytes())
    assert huge.scores(np.array([[2.0**20 + 1]])).tolist() == [[(2**40 * (2**20 + 1) + (1 << 63)) % (1 << 64) - (1 << 63)]]


# ---- 10


def brute_rules(t):
    t = t or ""
    w = re.findall(SPACE, t)
    lines, dup, spots, covered = set(), 0, {}, set()
    for x in t.split("\n"):
        if re.search(SPACE, x):
            dup += x in lines
            lines.add(x)
    for i in range(len(w) - 2):
        spots.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in spots.values():
        covered |= {i + k for i in at for k in range(3)} if len(at) > 1 else set()
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_rules(docs, empty):
    out = rules.judge(docs)
    got = by_id(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(TEXTS):
        assert got[i] == brute_rules(t), t
    assert out.count() == docs.count() and out.where("base_failed and kept").count() == 0 and rules.judge(empty).count() == 0
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id in {x.doc_id for x in out.where("kept").collect()})


def brute_fences(rows):
    """Fences of (lang, source, metric values) rows by sorting; small groups take those of their language, or of all."""
    out = {}
    size = lambda v: 1 << max(v.bit_length() - rules.KEPT_BITS, 0)
    for k in range(len(rules.METRICS)):
        for lang, source in {r[:2] for r in rows}:
            levels = ([r[2][k] for r in rows if r[:2] == (lang, source)], [r[2][k] for r in rows if r[0] == lang], [r[2][k] for r in rows])
            own = sorted(v // size(v) * size(v) for v in next((x for x in levels[:2] if len(x) >= rules.LEAST_GROUP), levels[2]))
            q1, q3 = (next(v for i, v in enumerate(own, 1) if 4 * i >= p * len(own)) for p in (1, 3))
            out[lang, source, k] = q3 + size(q3) + rules.REACH * (q3 + size(q3) - q1)
    return out


def test_adaptive_fences(spark):
    """Verdicts against fences by brute force; they differ by language and source, and decide."""
    rng = random.Random(14)
    rows = []
    for i in range(700):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a"), ("de", "rare" if i % 20 == 0 else "c"), (None, None)])
        marks = rng.randrange(4, 9) if source == "a" else rng.randrange(14, 30)  # one source's usual is the other's outlier
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 12 if lang == "de" else 8))) for _ in range(60)]
        words += ["x" + "," * marks] + ["y%%%%%" * 4] * (40 if i % 23 == 0 else 0) + ["y;;;;;;;;"] * (8 if i % 31 == 0 else 0)
        rows.append((i, " ".join(words), lang, source))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = by_id(rules.judge(d), "kept", "base_failed")
    punct = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    measured = {}
    for i, t, lang, source in rows:
        n, chars = len(t.split()), sum(map(len, t.split()))
        measured[i] = (lang, source, (1000 * sum(c in punct for c in t) // chars, 1000 * sum("A" <= c <= "Z" for c in t) // chars, 100 * chars // n))
    fences = brute_fences([m for i, m in measured.items() if not got[i][1]])
    for i, m in measured.items():
        assert got[i][0] == (not got[i][1] and all(v <= fences[m[0], m[1], k] for k, v in enumerate(m[2]))), i
    assert len({v for (_, _, k), v in fences.items() if k == 0}) > 3 and len({v for (_, _, k), v in fences.items() if k == 2}) > 2
    mark = lambda i, s: measured[i][2][0] <= fences["en", s, 0]
    own = [i for i in measured if measured[i][:2] == ("en", "a")]
    assert any(mark(i, "b") and not mark(i, "a") for i in own) and 0 < sum(not got[i][0] for i in own) < len(own) / 4  # with the neighbour's fence these would stay


def test_rules_are_native(docs):
    plan = rules.judge(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- the pipeline


def test_pipeline(spark):
    import corpus_pipeline
    from quillspark.runtime import table

    sf = "/root/testdata/sf0.001"
    d = table(spark, sf, "documents")
    first = corpus_pipeline.quality_classifier(spark, d, sf)
    assert first.columns == d.columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in resampling.resample(d, table(spark, sf, "labels")).where("kept").collect()}
    second = corpus_pipeline.quality_rules(spark, first, sf)
    assert second.columns == d.columns and {r.doc_id for r in second.collect()} == {r.doc_id for r in rules.judge(first).where("kept").collect()}
    third = corpus_pipeline.near_dedup(spark, second, sf).collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in second.collect()}
    assert sorted(r.doc_id for r in third) == sorted({*brute_components(fps).values()})
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in third}


# ---- queries


@pytest.mark.parametrize("name", ["op2_warc", "op7_topk", "op10_rules"])
def test_queries_against_sql(spark, name):
    import duckdb

    from quillspark.llm import queries

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), db.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted((tuple(None if v is None or v != v else int(v) if isinstance(v, float) else v for v in r) for r in d[sorted(d.columns)].astype(object).replace({pd.NA: None}).values.tolist()), key=str)
    assert list(map(str, rows(got))) == list(map(str, rows(want)))
