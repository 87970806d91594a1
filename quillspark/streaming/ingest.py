"""Resumable ingest: new files become chunks once; the checkpoint knows what was done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.chunk import structured_chunks


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = structured_chunks) -> int:
    """Process the Parquet files of source that earlier calls haven't seen into sink; returns the rows of this call.

    Each micro-batch is written to a folder of its own number, so that a batch that runs again replaces itself.
    """
    rows = 0

    def batch(df: DataFrame, number: int) -> None:
        nonlocal rows
        out = f"{sink}/batch={number}"
        transform(df).write.mode("overwrite").parquet(out)
        rows += spark.read.parquet(out).count()

    stream = spark.readStream.schema(schema).parquet(source)
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows
