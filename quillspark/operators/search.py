"""Field search over positional postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import keys_differ, materialize
from .analyze import ascii_words, word_runs


def phrase_words(phrases: DataFrame, key: str = "qid", phrase: str = "phrase") -> DataFrame:
    """(key, term, n): a phrase's distinct ASCII words and how many it has."""
    w = F.array_distinct(ascii_words(F.col(phrase)))
    return phrases.select(key, w.alias("w")).select(key, F.size("w").alias("n"), F.explode("w").alias("term"))


def search_fields(places: DataFrame, phrases: DataFrame, key: str = "qid", phrase: str = "phrase", doc: str = "doc_id") -> DataFrame:
    """(key, doc): documents of which a single field has all words of a phrase, anywhere. An empty phrase finds none."""
    wanted = phrase_words(phrases, key, phrase)
    known = places.select("field", "term", doc)
    n_places = known.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("places"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("places", "term"))
    ranked = wanted.join(n_places, "term").withColumn("r", place)
    # the rarest word finds candidates; the others are looked up where those are
    found = known.join(ranked.where("r = 1").select(key, "term", "n"), "term").select(key, "field", doc, "n").distinct()
    rest = found.where("n > 1").join(ranked.where("r > 1").select(key, "term"), key)
    has = rest.join(known, ["field", doc, "term"], "left_semi").groupBy(key, "field", doc).agg(F.count(F.lit(1)).alias("has"), F.max("n").alias("n"))
    return found.where("n = 1").select(key, doc).union(has.where("has = n - 1").select(key, doc)).distinct()


def search_rows(docs: DataFrame, fields: list[str], phrases: DataFrame, key: str = "qid", phrase: str = "phrase", doc: str = "doc_id") -> DataFrame:
    """search_fields() of documents that are one row each, without their postings: a row that has a phrase's rarest
    word in a field is looked through for the others, so that nothing but found pairs is shuffled. Phrases are a batch of queries, which all executors hold."""
    value = F.explode(F.array(*[F.col(f).cast("string") for f in fields]))
    texts = docs.select(doc, value.alias("value")).select(doc, F.array_distinct(word_runs(F.col("value"))).alias("has"))
    wanted = phrase_words(phrases, key, phrase)
    n_places = texts.select(F.explode("has").alias("term")).join(F.broadcast(wanted.select("term").distinct()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("places"))
    # words that no text has are the rarest
    ranked = wanted.join(n_places, "term", "left").groupBy(key, "n").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "term")).alias("rarest"), F.collect_list("term").alias("all"))
    rarest = materialize(ranked.where("rarest.places > 0").select(key, "all", F.col("rarest.term").alias("term")), "rarest")
    found = texts.select(doc, "has", F.explode("has").alias("term")).join(F.broadcast(rarest), "term")
    return found.where(F.size(F.array_except("all", "has")) == 0).select(key, doc).distinct()


def count_documents(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """(term, n_docs): how many documents have an ASCII word in any of the fields."""
    runs = F.array_distinct(F.flatten(F.array(*[word_runs(F.col(f).cast("string")) for f in fields])))
    pairs = docs.where(F.col(key).isNotNull()).select(key, F.explode(runs).alias("term")).where(F.col("term").rlike("^[a-z]+$"))
    return (pairs if keys_differ(docs, key) else pairs.distinct()).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


def _first(corrections: DataFrame, most: int) -> DataFrame:
    return corrections.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("n") <= most).drop("n")


def first_corrections(corrections: DataFrame, places: DataFrame, most: int = 10) -> DataFrame:
    """(qid, rank, phrase, doc_id) of each query's first corrections (qid, rank, phrase) and the documents they find."""
    top = _first(corrections, most).withColumn("cid", F.concat_ws(":", "qid", "rank"))
    return top.join(search_fields(places, top, "cid"), "cid", "left").select("qid", "rank", "phrase", "doc_id")


def counted_corrections(corrections: DataFrame, counts: DataFrame, most: int = 10) -> DataFrame:
    """(qid, rank, phrase, n_docs) of each query's first corrections, phrases of one word in lower case, and how many
    documents (counts of count_documents()) they find; no correction meets the documents themselves."""
    n = counts.select(F.col("term").alias("phrase"), "n_docs")
    return _first(corrections, most).join(n, "phrase", "left").select("qid", "rank", "phrase", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
