"""Vector retrieval: exact nearest neighbours by squared Euclidean distance, reranking, and checks of a store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


PART_ROWS = 100_000


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed in doubles; null where the sizes differ."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def nearest(vectors: DataFrame, query: list[float], k: int = 7) -> DataFrame:
    """The k rows nearest to one query, with d2; ties to the smaller vec_id. Fewer rows than k: all."""
    q = F.array(*[F.lit(float(x)) for x in query])
    same = vectors.where(F.size("embedding") == len(query))
    return same.withColumn("d2", squared_distance(F.col("embedding"), q)).orderBy("d2", "vec_id").limit(k)


#: Queries that one product of matrices answers.
_TOGETHER = 32


def _closest(m: np.ndarray, xs: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each row of xs the rows of m that can be among its k nearest, and their squared distances.

    One product gives all distances but for rounding; what is as near as the kth or farther by no more than rounding
    can make it is measured again by differences, as the result has it.
    """
    rows = [np.arange(len(m))] * len(xs)
    norms, own = (m * m).sum(axis=1), (xs * xs).sum(axis=1)
    if len(m) > k and np.isfinite(norms).all() and np.isfinite(own).all():
        rough = norms - 2 * (xs @ m.T)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        rows = [np.flatnonzero(r <= t) for r, t in zip(rough, kth + 1e-9 * (norms.max() + own), strict=True)]
    d = [((m[r] - x) ** 2).sum(axis=1) for r, x in zip(rows, xs, strict=True)]
    return rows, d


def nearest_of_all(vectors: DataFrame, queries: DataFrame, k: int = 7, chunk: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, d2): the k nearest vectors (vec_id, embedding) to each query (query_id, embedding).

    Vectors of another size than a query's are no candidates of it; null ones and those with a null or no id take no part.
    Chunks of queries meet partitions of at most PART_ROWS vectors or so, held as one matrix by size; a partition sends
    k rows for a query.
    """
    spark = vectors.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // PART_ROWS))
    whole = lambda e: F.col(e).isNotNull() & F.forall(e, lambda x: x.isNotNull())
    v = vectors.where(F.col("vec_id").isNotNull() & whole("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    asked = queries.where(F.col("query_id").isNotNull() & whole("embedding"))
    packed = asked.select(F.floor(F.pmod(F.xxhash64("query_id"), F.lit(1 << 40)) % F.greatest(F.lit(1), F.lit(queries.count() // chunk))).alias("c"), F.struct(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e")).alias("q"))
    chunks = materialize(packed.groupBy("c").agg(F.sort_array(F.collect_list("q")).alias("qs")), "queries")
    # no null ids: pandas would turn the column to doubles, which hold no more than 53 bits
    q = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"), "qs")
    both = v.select("part", F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(None).cast(q.schema["qs"].dataType).alias("qs")).unionByName(q)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, made = None, {}, {}  # by size: ids and matrices as they come, then as one

        def of_size(size: int) -> tuple[np.ndarray, np.ndarray]:
            if size not in made:
                ids, rows = held.get(size, ([], []))
                made[size] = (np.concatenate(ids), np.concatenate(rows)) if ids else (np.zeros(0, np.int64), np.zeros((0, size)))
            return made[size]

        for f in frames:
            for (p, kind), rows in f.groupby(["part", "kind"], sort=True):
                if p != part:
                    part, held, made = p, {}, {}
                if kind == 0:
                    for size, same in rows.groupby(rows["embedding"].map(len)):
                        ids, ms = held.setdefault(size, ([], []))
                        ids.append(same["vec_id"].to_numpy(np.int64))
                        ms.append(np.array(same["embedding"].tolist(), float).reshape(len(same), size))
                    continue
                got = [[], [], []]
                asked_of: dict[int, list] = {}
                for one in (x for qs in rows["qs"] for x in qs):
                    asked_of.setdefault(len(one["e"]), []).append(one)
                for size, ones in asked_of.items():
                    at, m = of_size(size)
                    for i in range(0, len(ones), _TOGETHER):
                        some = ones[i : i + _TOGETHER]
                        for one, near, d in zip(some, *_closest(m, np.array([x["e"] for x in some], float).reshape(len(some), size), k), strict=True):
                            for j in np.lexsort((at[near], d))[:k]:
                                for c, value in zip(got, (one["id"], int(at[near[j]]), float(d[j])), strict=True):
                                    c.append(value)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "d2"), got, strict=True)))

    found = both.repartition(n, "part").sortWithinPartitions("part", "kind").mapInPandas(run, "query_id long, vec_id long, d2 double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "d2")


def check_store(vectors: DataFrame, dimension: int) -> DataFrame:
    """(n_rows, n_null, min_dim, max_dim, n_wrong) of a store; a store is sound if nothing is null or wrong."""
    size = F.size("embedding")
    return vectors.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("embedding").isNull().cast("long")), F.lit(0)).alias("n_null"),
        F.min(F.when(F.col("embedding").isNotNull(), size)).alias("min_dim"), F.max(F.when(F.col("embedding").isNotNull(), size)).alias("max_dim"),
        F.coalesce(F.sum((F.col("embedding").isNotNull() & (size != dimension)).cast("long")), F.lit(0)).alias("n_wrong"),
    )


def store(vectors: DataFrame, path: str, dimension: int) -> tuple[int, int]:
    """Write vectors, read them back and check them; returns (rows, rows checked). An unsound or empty store raises."""
    want = vectors.count()
    if not want:
        raise ValueError("nothing to store")
    vectors.write.mode("overwrite").parquet(path)
    got = check_store(vectors.sparkSession.read.parquet(path), dimension).first()
    if got.n_rows != want or got.n_null or got.n_wrong:
        raise ValueError(f"the store is unsound: {got.asDict()}")
    return want, got.n_rows


def rerank(pairs: DataFrame, score: Callable[[Column, Column], Column], query: str = "query", text: str = "text") -> DataFrame:
    """pairs with a score of (query, text), highest first."""
    return pairs.withColumn("score", score(F.col(query), F.col(text))).orderBy(F.desc("score"), *[c for c in ("vec_id", "doc_id") if c in pairs.columns])
