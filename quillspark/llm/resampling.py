"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text (a bounded sample of the documents labelled good) and
one of the whole raw corpus, give every document a log ratio of likelihoods. Gumbel noise is added and the top k keys
stay, which samples k documents without replacement in proportion to that ratio. k follows the labels: the share of
good ones among them, of all documents.

n-grams are runs of letters and runs of other characters inside words, and pairs of neighbouring runs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship
from .arrow import Memo, cache_of, enter, small_batches, texts_of

BITS = 16
SIZE = 2 << BITS  # single runs, then pairs
_RUNS = re.compile(r"[^\W\d_]+|[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(chunk: str) -> bytes:
    from xxhash import xxh64_intdigest

    return b"".join([xxh64_intdigest(r.encode("utf-8", "replace")).to_bytes(8, "little") for r in _RUNS.findall(chunk)])


_memo = Memo(_hashes)
cache_of("resampling", _memo.forget)


def buckets(text: str) -> np.ndarray:
    """The hashed n-grams of a text."""
    h = np.frombuffer(b"".join(map(_memo.__getitem__, text.split())), "<u8")
    shift = np.uint64(64 - BITS)
    pairs = ((h[:-1] * _MIX) ^ h[1:]) * _MIX
    return np.concatenate([h >> shift, (pairs >> shift) + np.uint64(1 << BITS)]).astype(np.int64)


def corpus_counts(docs: DataFrame, target_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of all documents and of those with a target id. The driver gets SIZE sums of each at most."""
    wanted = np.sort(np.asarray(target_ids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("resampling")
        raw, target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        for b in small_batches(batches, "text"):
            ids = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            known = np.isin(ids, wanted) & ~b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for t, is_target in zip(texts_of(b.column("text")), known.tolist(), strict=True):
                got = buckets(t)
                if len(got) < 4096:
                    np.add.at(raw, got, 1)
                    if is_target:
                        np.add.at(target, got, 1)
                else:
                    c = np.bincount(got, minlength=SIZE)
                    raw += c
                    if is_target:
                        target += c
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = d.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(SIZE), np.zeros(SIZE)
    raw[sums.bucket], target[sums.bucket] = sums.raw, sums.target
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, smooth: float = 4.0) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket; raw counts are scaled to the target's total and both are smoothed
    alike, so that what is rare tells nothing. Without target text all are zero."""
    out = np.zeros(SIZE, np.float32)
    for part in (slice(0, SIZE // 2), slice(SIZE // 2, SIZE)):
        r, t = raw[part].sum(), target[part].sum()
        if r and t:
            out[part] = np.log(target[part] + smooth) - np.log(raw[part] * (t / r) + smooth)
    return out


def score(model: np.ndarray, text: Column) -> Column:
    """The log ratio of a text under a model; 0 for null and empty ones."""

    @F.pandas_udf("double")
    def log_ratio(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enter("resampling")
        for s in parts:
            yield pd.Series([float(model[buckets(t)].sum(dtype=np.float64)) if t else 0.0 for t in s], dtype="float64")

    return log_ratio(text)


def gumbel(key: Column, seed: int = 5) -> Column:
    """Standard Gumbel noise, fixed by the key."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The kth largest value of a finite double column by counts in ever narrower bins (4096 at a time on the driver)."""
    n = df.count()
    if k <= 0 or n == 0:
        return math.inf
    if k >= n:
        return -math.inf
    low, high = df.agg(F.min(column), F.max(column)).first()
    above = 0  # values over high
    for _ in range(12):
        if not low < high:
            break
        width = (high - low) / 4096
        if low + width == low:
            break
        here = df.where(F.col(column).between(low, high))
        bins = {r[0]: r[1:] for r in here.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(4095)).alias("b")).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b][0] >= k:
                low, high = bins[b][1], bins[b][2]
                break
            above += bins[b][0]
    return low


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> tuple[np.ndarray, float]:
    """The model and the share of good documents among the labelled. The target is the text of at most `most_labelled`
    documents labelled good, chosen by a hash of the id; all else counts over all documents."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).collect()]
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    raw, target = corpus_counts(docs, np.array(ids, np.int64))
    return log_ratios(raw, target), 1.0 if share is None else float(share)


def _keyed(docs: DataFrame, labels: DataFrame, keep_share: float | None, names: tuple[str, str]) -> tuple[DataFrame, float]:
    ship(docs.sparkSession)
    model, share = fit(docs, labels)
    out = docs.withColumn(names[0], score(model, F.col("text"))).withColumn(names[1], F.col(names[0]) + gumbel(F.col("doc_id")))
    out = materialize(out, "importance")
    share = share if keep_share is None else keep_share
    cut = kth_largest(out, names[1], math.ceil(share * out.count()))
    return out, cut


def resample(docs: DataFrame, labels: DataFrame, keep_share: float | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, log_ratio, key, kept.

    docs' further columns are ignored. Null and empty texts have a log ratio of 0; rows that tie with the kth key are
    kept; repeated rows get the same key. Without labels every row is kept. An empty table gives no rows.
    """
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ship(docs.sparkSession)
    model, share = fit(d, labels)
    keyed = materialize(d.select("doc_id", score(model, F.col("text")).alias("log_ratio")).withColumn("key", F.col("log_ratio") + gumbel(F.col("doc_id"))), "importance")
    share = share if keep_share is None else keep_share
    cut = kth_largest(keyed, "key", math.ceil(share * keyed.count()))
    return keyed.withColumn("kept", F.col("key") >= F.lit(cut))


def keep_resampled(docs: DataFrame, labels: DataFrame, keep_share: float | None = None) -> DataFrame:
    """The rows of docs that resample() keeps, with all their columns."""
    names = tuple(n + "_" * max(len(c) for c in docs.columns) for n in ("__ratio", "__key"))
    keyed, cut = _keyed(docs, labels, keep_share, names)
    return keyed.where(F.col(names[1]) >= F.lit(cut)).drop(*names)
