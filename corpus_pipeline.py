"""A corpus pipeline: quality classifier, quality rules, SimHash near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages but the last keep docs'
columns. run() writes each stage's result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import packing, resampling, rules, simhash
from quillspark.runtime import made_so_far, materialize, release, remove_since, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that importance resampling doesn't draw."""
    return resampling.keep_resampled(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail a fixed or an adaptive rule."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies."""
    return simhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; returns the pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("packing", pack),
]

#: Sampling by a hash, XXH64 and the tokenizer are beyond DuckDB's SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote for itself goes once its result is written, and so does the result
    before it.

    Nulls, ties, repeated rows, empty tables and columns of any name are what the stages' operators say: null and empty
    texts have too few words and go with the rules; rows that tie with the last key drawn stay; of repeated rows one is
    left; an empty table gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, before = made_so_far(), docs
        docs = materialize(stage(spark, before, sf_dir), f"stage-{name}")
        remove_since(mark, docs)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
