"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated isotonically.

The labelled training rows (a bounded sample, by a hash of the id) are split in three: one part gives the lexicons
(words, and beginnings of words, that toxic documents hold more often, by the lower bound of the log odds), one grows
the trees, one calibrates. Nothing but the text enters a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .arrow import Memo, small_batches, texts_of

SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ya du dich dir dein deine deinen deiner deines euch euer eure ihr tu te toi ton tes vous votre vos ti tus usted ustedes vosotros vuestro vuestra".split()
)
PREFIX = 5
FEATURES = (
    "word_density", "word_most", "word_hits", "prefix_density", "prefix_most", "prefix_hits", "masked_density", "near_you", "you_rate",
    "upper_rate", "shouted_rate", "punctuation_rate", "exclamation_rate", "question_rate", "masked_rate", "log_words",
)
_PLAIN = str.maketrans("013457@$!|*", "oieastasiii")
_EDGE = ".,;:!?\"'()[]{}…«»-|#%&*$"


def core(chunk: str) -> str:
    """A word without the punctuation around it, in lower case."""
    return chunk.strip(_EDGE).lower()


class Lexicon:
    """Weights of words and of their beginnings."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float]):
        self.words, self.prefixes = words, prefixes
        self.memo = Memo(self._row)

    def __reduce__(self):
        return Lexicon, (self.words, self.prefixes)

    def _row(self, chunk: str) -> bytes:
        w = core(chunk)
        masked = any(c.isalpha() for c in w) and not w.isalpha() and any(c in "013457@$!|*" for c in w)
        plain = w.translate(_PLAIN) if masked else ""
        letters = sum(map(str.isalpha, chunk))
        return np.array(
            [self.words.get(w, 0.0), self.prefixes.get(w[:PREFIX], 0.0) if len(w) >= PREFIX else 0.0, self.words.get(plain, 0.0) if masked else 0.0, w in SECOND_PERSON,
             sum(map(str.isupper, chunk)), len(w) > 2 and w.isalpha() and chunk.strip(_EDGE).isupper(), len(chunk) - letters - sum(map(str.isdigit, chunk)),
             chunk.count("!"), chunk.count("?"), masked, len(chunk)], "<f4",
        ).tobytes()

    def features(self, text: str) -> np.ndarray:
        """The dense features of a text; all zero without words."""
        x = np.frombuffer(b"".join(map(self.memo.__getitem__, text.split())), "<f4").reshape(-1, 11)
        n = len(x)
        if not n:
            return np.zeros(len(FEATURES))
        word, prefix, plain, you, upper, shouted, punct, excl, quest, masked, chars = x.T
        hit = (word > 0) | (prefix > 0) | (plain > 0)
        seen = np.r_[0, np.cumsum(you)]
        at = np.flatnonzero(hit)
        near = (seen[np.minimum(at + 6, n)] - seen[np.maximum(at - 5, 0)] > 0).mean() if len(at) else 0.0
        total = max(float(chars.sum(dtype=np.float64)), 1.0)
        sums = x.sum(axis=0, dtype=np.float64)
        return np.array([
            sums[0] / n, word.max(), (word > 0).sum(), sums[1] / n, prefix.max(), (prefix > 0).sum(), sums[2] / n, near, sums[3] / n,
            sums[4] / total, sums[5] / n, sums[6] / total, sums[7] / n, sums[8] / n, sums[9] / n, math.log1p(n),
        ])


class Trees:
    """Boosted regression trees of logistic loss over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, leaf: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.ridge = rounds, depth, rate, bins, leaf, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = math.log(p / (1 - p))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
        binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]  # a bin holds values up to its edge
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds if len(np.unique(y)) == 2 else 0):
            q = 1 / (1 + np.exp(-margin))
            g, h = y - q, q * (1 - q)
            tree: list[tuple] = []
            self._grow(tree, np.arange(len(y)), binned, edges, g, h, self.depth)
            self.trees.append(tree)
            margin += self._one(tree, x)
        return self

    def _grow(self, tree, rows, binned, edges, g, h, depth) -> int:
        at = len(tree)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = self.rate * gs / (hs + self.ridge)
        tree.append((-1, 0.0, 0, 0, value))
        best = (1e-6, -1, 0)
        if depth and len(rows) >= 2 * self.leaf:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[j][rows]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(nl < self.leaf) | (len(rows) - nl < self.leaf)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] >= 0:
            _, j, k = best
            low = binned[j][rows] <= k
            a = self._grow(tree, rows[low], binned, edges, g, h, depth - 1)
            b = self._grow(tree, rows[~low], binned, edges, g, h, depth - 1)
            tree[at] = (j, float(edges[j][k]), a, b, value)
        return at

    def _one(self, tree, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            j, edge, a, b, value = tree[k]
            if j < 0:
                out[rows] = value
            elif len(rows):
                low = x[rows, j] <= edge
                todo += [(a, rows[low]), (b, rows[~low])]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._one(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margins, probabilities) of the non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for v, t in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1.0, v])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][2] / blocks[-2][1] == blocks[-1][2] / blocks[-1][1]):
            s, n, u = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + u]
    return np.array([u / n for _, n, u in blocks]), np.array([s / n for s, n, _ in blocks])


class Model:
    """Lexicons, trees and calibration."""

    def __init__(self, lexicon: Lexicon, trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(-1, len(FEATURES))
        m = self.trees.margin(x)
        if not len(self.knots[0]):
            return 1 / (1 + np.exp(-m))
        return np.clip(np.interp(m, *self.knots), 0.0, 1.0)


def held_out(doc_id) -> F.Column:
    """Whether a row is never trained on: crc32 of its id as text is a multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 24_000) -> Model:
    """A model from at most `most_labelled` labelled rows outside the held-out fold, each id once; the lexicons hold what
    five toxic ones among them share. Only counts, features and labels of those rows reach the driver."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("y")).where("doc_id is not null and y is not null")
    lab = lab.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(9)))
    rows = lab.orderBy("h", "doc_id").limit(most_labelled).collect()
    part = {r[0]: (k % 4, r[1]) for k, r in enumerate(rows)}
    spark = docs.sparkSession
    some = F.broadcast(spark.createDataFrame([(d, p, y) for d, (p, y) in part.items()], "doc_id long, part int, y int"))
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(some, "doc_id")
    t = t.groupBy("doc_id", "part", "y").agg(F.max("text").alias("text"))  # a repeated id counts once

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for b in small_batches(batches, "text"):
            counts = (Counter(), Counter())
            for text, y in zip(texts_of(b.column("text")), b.column("y").to_pylist(), strict=True):
                words = {core(c) for c in text.split()} - {""}
                counts[y].update("w" + w for w in words)
                counts[y].update({"p" + w[:PREFIX] for w in words if len(w) >= PREFIX})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][k] for k in names], pa.int64()), pa.array([counts[0][k] for k in names], pa.int64())], names=["k", "pos", "neg"])

    first = t.where("part < 2")
    n = {r[0]: r[1] for r in first.groupBy("y").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    sums = first.select("text", "y").mapInArrow(keys, "k string, pos long, neg long").groupBy("k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 5")
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1)) - 2 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    top = sums.withColumn("weight", odds).where("weight > 0.5")
    words, prefixes = ({r.k[1:]: float(r.weight) for r in top.where(F.col("k").startswith(x)).collect()} for x in "wp")
    lexicon = Lexicon(words, prefixes)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            x = [lexicon.features(s).tolist() for s in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["part", "y", "x"])

    got = sorted(t.where("part >= 2").select("part", "y", "text").mapInArrow(featured, "part int, y int, x array<double>").collect())
    x = np.array([r.x for r in got]).reshape(-1, len(FEATURES))
    y = np.array([r.y for r in got], float)
    p = np.array([r.part for r in got])
    trees = Trees().fit(x[p == 2], y[p == 2])
    return Model(lexicon, trees, isotonic(trees.margin(x[p == 3]), y[p == 3]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts have zero features and are scored like any; a null doc_id has a null held_out fold, given as
    false; repeated rows get the same score; other columns are ignored; without labels every score is the prior's.
    """
    ship(docs.sparkSession)
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 4 << 20):
            s = model.score(texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = d.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
