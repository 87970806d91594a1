"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits differ in at most two of the bits outside one of three blocks (the
block that holds most of the differing ones). So every distinct fingerprint emits, for each of the three blocks left
out, all variants of its other bits within half of that radius (one bit): close fingerprints meet on a variant.
The variants are shuffled; the members of each are deduplicated and verified on all 64 bits.

What a variant's group yields is a spanning set of its links, never all pairs: members that share the block left out
are within two bits and are chained, then members whose blocks differ in one bit, and only what is still apart is
compared, block by block. Exact copies are one fingerprint from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship
from .arrow import enter, small_batches
from .components import components

#: The bits left out, as (lowest, how many).
BLOCKS = ((0, 22), (22, 21), (43, 21))
RADIUS = 3
FULL = (1 << 64) - 1


def _signed(x: int) -> int:
    x &= FULL
    return x - (1 << 64) if x >> 63 else x


def fingerprint_texts(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64): majority bits of XXH64 over shingles of `width` words of the A-Z lower-cased text.

    Fewer words than a shingle: the whole sequence is one; no words: zero.
    """
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    sizes, rows = [], []
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        if not w:
            continue
        if len(w) <= width:
            h = [xxh64_intdigest(b" ".join(w), seed)]
        elif width == 3:
            h = [xxh64_intdigest(b"%b %b %b" % x, seed) for x in zip(w, w[1:], w[2:], strict=False)]
        else:
            h = [xxh64_intdigest(b" ".join(w[k : k + width]), seed) for k in range(len(w) - width + 1)]
        hashes += h
        sizes.append(len(h))
        rows.append(i)
    if rows:
        n = np.array(sizes)
        ends = np.cumsum(n)
        flat = np.array(hashes, np.uint64)
        counts = np.zeros((len(n), 64), np.int64)
        step = 1 << 17  # shingles whose bits are held at once
        at = np.searchsorted(ends, np.arange(0, len(flat), step), side="right")
        for k, first in enumerate(at):
            part = flat[k * step : (k + 1) * step]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            last = int(np.searchsorted(ends, k * step + len(part), side="left"))
            starts = np.maximum(ends[first : last + 1] - n[first : last + 1] - k * step, 0)
            counts[first : last + 1] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        major = counts * 2 > n[:, None]
        out[rows] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, fp) per row of docs, and other long columns; fp is the fingerprint as a signed long. Null texts count as
    empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for b in small_batches(batches, "text"):
            fp = fingerprint_texts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), *map(b.column, also)], names=["doc_id", "fp", *also])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *also)
    return d.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


class Forest:
    """Union-find over longs; forgets all at a bound, which only repeats links."""

    def __init__(self, limit: int = 500_000):
        self.up: dict[int, int] = {}
        self.limit = limit

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        if len(self.up) > self.limit:
            self.up.clear()
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def group_links(fps: np.ndarray, block: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning set of the links (at most RADIUS bits apart) among distinct fingerprints of one variant's group."""
    n = len(fps)
    if n == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= RADIUS else []
    forest, out = Forest(1 << 62), []

    def link(pairs):
        for a, b in pairs:
            if forest.join(a, b):
                out.append((a, b))

    left = (fps >> np.uint64(block[0])) & np.uint64((1 << block[1]) - 1)
    if n > 32:
        order = np.argsort(left, kind="stable")
        s = left[order]
        same = np.flatnonzero(s[1:] == s[:-1])
        link(zip(order[same].tolist(), order[same + 1].tolist(), strict=True))
        values, first = s[np.r_[True, s[1:] != s[:-1]]], order[np.r_[True, s[1:] != s[:-1]]]
        for bit in range(block[1]):
            other = values ^ np.uint64(1 << bit)
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            hit = np.flatnonzero((values[at] == other) & (values < other))
            link(zip(first[hit].tolist(), first[at[hit]].tolist(), strict=True))
    roots = np.fromiter((forest.root(i) for i in range(n)), np.int64, n)
    names, sizes = np.unique(roots, return_counts=True)
    if len(names) > 1:  # all but the largest part are held against everything
        apart = np.flatnonzero(roots != names[np.argmax(sizes)])
        for k in range(0, len(apart), max(1, (1 << 22) // n)):
            rows = apart[k : k + max(1, (1 << 22) // n)]
            d = np.bitwise_count(fps[rows, None] ^ fps[None, :])
            a, b = np.nonzero(d <= RADIUS)
            keep = roots[rows[a]] != roots[b]
            link(zip(rows[a[keep]].tolist(), b[keep].tolist(), strict=True))
    return out


def _links_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, variant, fp), sorted by block and variant: the spanning links of each group."""
    forest = Forest()
    rest = [np.zeros(0, np.int64)] * 3

    def done(block, variant, fp):
        new = np.r_[True, (block[1:] != block[:-1]) | (variant[1:] != variant[:-1])] if len(fp) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(fp)])
        x, y = [], []
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            group = np.unique(fp[s : s + n].view(np.uint64))
            if len(group) < 2:
                continue
            ids = group.view(np.int64)
            for a, b in group_links(group, BLOCKS[int(block[s])]):
                a, b = int(ids[a]), int(ids[b])
                if forest.join(a, b):
                    x.append(a)
                    y.append(b)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    for b in batches:
        cols = [np.concatenate([r, b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, ("block", "variant", "fp"), strict=True)]
        if not len(cols[0]):
            continue
        open_ = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])  # the last group may go on
        cut = len(open_) - int(open_.sum())
        rest = [c[cut:] for c in cols]
        yield done(*[c[:cut] for c in cols])
    yield done(*rest)


def links(distinct_fps: DataFrame) -> DataFrame:
    """(x, y): fingerprints at most three bits apart, a set that spans every component. distinct_fps: fp."""
    marks = []
    for k, (low, n) in enumerate(BLOCKS):
        keep = FULL ^ (((1 << n) - 1) << low)
        flips = [0, *(1 << b for b in range(64) if keep >> b & 1)]
        marks += [(k, _signed(keep), _signed(f)) for f in flips]
    mark = F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("block"), F.lit(m).alias("keep"), F.lit(f).alias("flip")) for k, m, f in marks]))
    v = distinct_fps.select("fp", mark.alias("v")).select(F.col("v.block").alias("block"), F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("variant"), "fp")
    spark = distinct_fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = v.repartition(n, "block", "variant").sortWithinPartitions("block", "variant")
    return v.mapInArrow(_links_task, "x long, y long")


def _grouped(fps: DataFrame) -> DataFrame:
    """The rows of fingerprints() with the root of their component (a fingerprint) and component_id."""
    fps = materialize(fps, "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    star = components(links(distinct.select("fp")))
    rooted = distinct.join(star.select(F.col("x").alias("fp"), F.col("y").alias("root")), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that
    links reach, itself included).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows are copies. A null doc_id gets a
    component but never names one. An empty table gives no rows; other columns are ignored.
    """
    out = _grouped(fingerprints(docs))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id. Of repeated rows of it one stays; texts that
    share a doc_id are told apart by their hashes. Rows without a doc_id stay, as nothing can be said of them. All
    columns are kept."""
    marked = docs.withColumn("__text", F.xxhash64(F.col("text").cast("string")))
    found = _grouped(fingerprints(marked, "__text")).where("doc_id is not null").select("doc_id", "__text", "root", "component_id")
    found = materialize(found, "near-duplicates")
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    gone = found.where("doc_id != component_id").select("doc_id", "__text")
    if repeated:
        heads = found.where("doc_id = component_id")
        kept = heads.groupBy("root").agg(F.min("__text").alias("__kept"))
        gone = gone.union(heads.join(kept, "root").where("__text != __kept").select("doc_id", "__text"))
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("__text").alias("__gone_text")).distinct()
    out = marked.join(gone, (marked["doc_id"] == F.col("__gone")) & (marked["__text"] == F.col("__gone_text")), "left_anti")
    if repeated:
        from pyspark.sql import Window

        first = F.row_number().over(Window.partitionBy("doc_id", "__text").orderBy(F.lit(0)))
        out = out.withColumn("__first", first).where("__first = 1 or doc_id is null").drop("__first")
    return out.drop("__text")
