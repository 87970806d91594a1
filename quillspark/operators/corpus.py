"""Corpus analysis: lengths, frequent terms, term-document counts and cosines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analyze import Analyzer


def lengths(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(doc_id, n_tokens)."""
    return docs.select("doc_id", F.size(analyzer.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def average_length(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(avg_tokens); null for an empty corpus."""
    return lengths(docs, analyzer).agg(F.avg("n_tokens").alias("avg_tokens"))


def top_terms(docs: DataFrame, analyzer: Analyzer, k: int = 10) -> DataFrame:
    """(term, n) of the k most frequent terms; ties by term."""
    return analyzer.terms(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k)


def term_counts(docs: DataFrame, group: str = "doc_id", text: str = "text") -> DataFrame:
    """(group, term, tf) of words of two or more word characters, in lower case."""
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return docs.select(group, F.explode(w).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf"))


def cosines(counts: DataFrame, group: str = "source") -> DataFrame:
    """(a, b, cosine) of all pairs of groups that share a term, the diagonal included. For few groups: pairs grow with
    the square of their number."""
    norm = counts.groupBy(group).agg(F.sqrt(F.sum(F.col("tf").cast("double") * F.col("tf"))).alias("norm"))
    a = counts.select(F.col(group).alias("a"), "term", F.col("tf").alias("x"))
    b = counts.select(F.col(group).alias("b"), "term", F.col("tf").alias("y"))
    dots = a.join(b, "term").groupBy("a", "b").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("dot"))
    out = dots.join(norm.select(F.col(group).alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col(group).alias("b"), F.col("norm").alias("nb")), "b")
    return out.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))
