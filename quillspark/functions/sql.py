"""The library in SQL: tables as views, operators as temporary functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import metrics
from ..operators.analyze import SPACE
from ..runtime import ship, table

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Temporary functions ts_words, ts_letters, ts_snippet, ts_soundex, ts_bleu, ts_rouge_l; views of the tables of sf_dir."""
    space = SPACE.replace("\\", "\\\\")
    made = (
        f"ts_words(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(coalesce(t, '')), '{space}+'), w -> w <> '')",
        r"ts_letters(a ARRAY<STRING>) RETURNS ARRAY<STRING> RETURN filter(a, w -> w RLIKE '^\\p{L}+$')",
        "ts_snippet(t STRING) RETURNS STRING RETURN concat(substring(t, 1, 500), '...')",
        r"ts_soundex(w STRING) RETURNS STRING RETURN substring(concat(upper(substring(w, 1, 1)), translate(substring(regexp_replace(regexp_replace("
        r"translate(upper(w), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000'), '[^0-6]', '0'), '(.)\\1+', '$1'), 2), '0', ''), '000'), 1, 4)",
    )
    for f in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
    ship(spark)
    spark.udf.register("ts_bleu", metrics.bleu_udf())
    spark.udf.register("ts_rouge_l", metrics.rouge_l_udf())
    for name in TABLES if sf_dir else ():
        table(spark, sf_dir, name).createOrReplaceTempView(name)
