"""Models as pluggable functions, with offline defaults: embedding, scoring, rewriting and generation."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from ..operators.analyze import STOP_WORDS, flat_line, only_letters, without, words

Embedder = Callable[[Sequence[str]], np.ndarray]


def hashed_embedding(texts: Sequence[str], dimension: int = 64) -> np.ndarray:
    """Offline default: signed hashed bags of words, of length one (zero for texts without words)."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, t in zip(out, texts, strict=True):
        h = [_word_hash(w) for w in t.lower().split()]
        row[:] = np.bincount([x % dimension for x in h], [1 if x >> 63 else -1 for x in h], dimension) if h else 0
        n = np.linalg.norm(row)
        if n:
            row /= n
    return out


@lru_cache(1 << 15)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def embed(chunks: DataFrame, embedder: Embedder = hashed_embedding, text: str = "text", batch: int = 50, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """chunks with an embedding, made in batches; a failing batch is tried again after a doubling wait."""

    ship(chunks.sparkSession)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts, out = [x or "" for x in s], []
            for i in range(0, len(texts), batch):
                for k in range(tries):
                    try:
                        out += list(embedder([t.replace("\n", " ") for t in texts[i : i + batch]]))
                        break
                    except Exception:
                        if k + 1 == tries:
                            raise
                        time.sleep(wait * 2**k)
            yield pd.Series(out)

    return chunks.withColumn("embedding", run(F.col(text)))


def overlap_score(query: Column, text: Column) -> Column:
    """Offline default of a cross-encoder: the share of the query's distinct words that the text has."""
    q, t = F.array_distinct(words(query)), words(text)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def rewrite(history: DataFrame, most: int = 8) -> DataFrame:
    """(conv_id, query): offline default of the rewriter, the last user turn's words without stop words."""
    last = history.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    kept = without(only_letters(words(F.col("text"))), STOP_WORDS)
    return last.select("conv_id", F.array_join(F.slice(kept, 1, most), " ").alias("query"))


def last_turn(history: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of each conversation's last turn."""
    return history.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def context(hits: DataFrame, group: str = "query_id", with_source: bool = False) -> DataFrame:
    """(group, context) of hits (group, rank, text, d2): a numbered line for each hit, in order of rank."""
    parts = [F.col("rank").cast("string"), F.lit("th retrieved chunk: "), F.col("text"), F.lit("... its squared distance: "), F.round("d2", 6).cast("string")]
    if with_source:
        parts += [F.lit(" its source document: "), F.col("source")]
    line = F.concat(*parts, F.lit("\n"))
    of = F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return hits.groupBy(group).agg(F.array_join(of, "").alias("context"))


def extract_answer(question: Column, context_: Column) -> Column:
    """Offline default of generation: the context's sentence that shares most words with the question, the first of equals."""
    sentences = F.filter(F.split(flat_line(context_), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    # the question's words are bound by an outer transform, so that they are found once and not for each sentence
    share = lambda q, t: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, words(t))) / F.size(q))
    scored = lambda q: F.transform(sentences, lambda s, i: F.struct(share(q, s).alias("score"), (-i).alias("at"), s.alias("s")))
    best = F.transform(F.array(F.array_distinct(words(question))), lambda q: F.array_max(scored(q))["s"])
    return F.coalesce(F.element_at(best, 1), F.lit(""))


def answer(questions: DataFrame, hits: DataFrame, generate: Callable[[Column, Column], Column] = extract_answer) -> DataFrame:
    """(query_id, answer) of questions (query_id, query) and their hits."""
    q = questions.join(context(hits), "query_id", "left")
    return q.select("query_id", generate(F.col("query"), F.coalesce("context", F.lit(""))).alias("answer"))


def best_first(hits: DataFrame, score: Callable[[Column, Column], Column] = overlap_score, k: int = 7) -> DataFrame:
    """Hits (query_id, query, text, ...) reranked in each query: rank by score."""
    s = hits.withColumn("score", score(F.col("query"), F.col("text")))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def cited_answer(questions: DataFrame, hits: DataFrame, generate: Callable[[Column, Column], Column] = extract_answer) -> DataFrame:
    """(query_id, context, answer): the answer to the original question in a line, and a line for each source of its
    hits (query_id, rank, text, d2, source), each source once, in order of rank."""
    named = hits.groupBy("query_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"])).alias("sources"))
    q = questions.join(context(hits, with_source=True), "query_id", "left").join(named, "query_id", "left")
    told = generate(F.col("query"), F.coalesce("context", F.lit("")))
    cited = F.array_join(F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.concat(F.lit("\nSOURCE: "), s)), "")
    return q.select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.concat(F.lit("Answer: "), told, cited).alias("answer"))
