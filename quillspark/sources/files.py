"""Readers and writers: documents, dictionaries, query files, binary files, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ABSTRACTS = "Index string, Title string, Author string, `Bibliographic Source` string, Abstract string"


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(doc_id, title, author, source, abstract) of JSON arrays, or of JSON lines (which Spark can split). Missing
    fields are null."""
    d = spark.read.schema(_ABSTRACTS).json(path, multiLine=not lines)
    return d.select(F.col("Index").cast("long").alias("doc_id"), F.col("Title").alias("title"), F.col("Author").alias("author"), F.col("Bibliographic Source").alias("source"), F.col("Abstract").alias("abstract"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, word): a word a line, trimmed, empty lines left out. The file is one partition: its order breaks ties."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "word"))
    return t.select(F.col("ord").cast("long").alias("ord"), F.trim("word").alias("word")).where("word <> ''")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query): a query a line, numbered from 1, empty lines left out."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "query"))
    return t.select((F.col("n") + 1).alias("qid"), F.trim("query").alias("query")).where("query <> ''")


def decode_text(content: bytes) -> str:
    """Default extractor: the bytes as UTF-8."""
    return content.decode("utf-8", "replace")


def read_binary(spark: SparkSession, folder: str, extract: Callable[[bytes], str] = decode_text, glob: str = "*.pdf") -> DataFrame:
    """(path, text) of the files that match; a file whose extraction fails has an empty text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(content: bytes) -> str:
            try:
                return extract(bytes(content))
            except Exception:  # a broken file isn't the others' loss
                return ""

        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [one(c) for c in f["content"]]})

    return files.mapInPandas(run, "path string, text string")


def table_text(rows: list[list[str | None]]) -> str:
    """A table's rows as aligned text, blank for null."""
    cells = [[(c or "").strip() for c in r] for r in rows]
    widths = [max((len(r[k]) if k < len(r) else 0) for r in cells) for k in range(max(map(len, cells), default=0))]
    return "\n".join(" ".join(c.rjust(w) for c, w in zip(r, widths, strict=False)) for r in cells)


def unprocessed(docs: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs that the manifest doesn't have."""
    return docs.join(manifest.select(key).distinct(), key, "left_anti")


def with_content_key(chunks: DataFrame, text: str = "text") -> DataFrame:
    """chunks with content_key, by which repeated work is recognized."""
    return chunks.withColumn("content_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def write_results(found: DataFrame, path: str, key: str = "doc_id") -> None:
    """A line for each query: its number and its documents in order."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_set(key)), lambda x: x.cast("string")), ", ")
    found.groupBy("qid").agg(ids.alias("ids")).select(F.concat(F.lit("query "), F.col("qid").cast("string"), F.lit(": "), F.col("ids")).alias("value")).write.mode("overwrite").text(path)


def write_table(table: DataFrame, path: str) -> None:
    """A table as CSV with a header."""
    table.write.mode("overwrite").option("header", True).csv(path)
