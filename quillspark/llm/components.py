"""Connected components of an edge table by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, release


def _sign(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 31)))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(x, y) for every node x that isn't the smallest of its component y. edges: long columns x and y, any order.

    Each round links a node's larger neighbours to its smallest one, then its smaller ones; the minimum is combined
    before the shuffle and joined back, so that a hub's links are dealt out. A round's edges are written to the shared
    folder. Self-links and repeats don't matter; null ends are dropped; no edges, no rows.
    """
    e = edges.where("x is not null and y is not null and x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    e = materialize(e, "links")
    sign = _sign(e)
    for _ in range(rounds):
        if not sign[0]:
            return e
        both = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        old, e = e, materialize(small.union(low.select("x", F.col("m").alias("y"))).distinct(), "links")
        release(old)
        was, sign = sign, _sign(e)
        if sign == was:
            return e
    raise RuntimeError(f"components did not settle in {rounds} rounds")
