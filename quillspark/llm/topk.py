"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are sorted by id and cut into blocks of neighbouring ids. A block is one row: a forward index (the ids and the
matrix of components) and the highest and lowest value of each component ("term"). A query's bound for a block sums,
over its components, the larger product with the block's two extremes. A query visits the blocks of a range in
descending order of bounds and scores whole blocks until the next bound is below its kth score so far.

Blocks belong to parts (ranges of at most PART_BLOCKS blocks). Every query is scored against its own part first; its
kth score there is the threshold that it takes to the other parts. A table of the parts' extremes, PARTS_A_ROW to a row,
bounds every query's score in each part, and a query travels to those parts alone whose bound reaches its threshold.
Chunks of queries meet the rows of that table, of which there are few: one for 16 million vectors. Each part sends k
candidates for a query at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, ship

BLOCK = 256
PART_BLOCKS = 64
PARTS_A_ROW = 1024
CHUNK = 256  # queries that travel together
_BLOCKS = "part long, kind int, size int, dim int, ids binary, matrix binary, high binary, low binary"
_FOUND = "query_id long, vec_id long, score long"
_EXACT = 1 << 53


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of every component; rows that are null, or hold nulls or non-finite
    components, and rows without an id are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return some.select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c).cast("double")).alias("v"))


def _padded(lists: list[np.ndarray], dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    for row, v in zip(out, lists, strict=True):
        row[: len(v)] = v
    return out


def _index_task(every: int, block: int, part_blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        made = 0
        last_query: int | None = None
        waiting: tuple[list[int], list[np.ndarray]] = ([], [])

        def row(kind: int, part: int, ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
            dim = max(map(len, vectors))
            m = _padded(vectors, dim)
            high, low = m.max(axis=0), m.min(axis=0)
            cols = [[part], [kind], [len(ids)], [dim], [np.array(ids, np.int64).tobytes()], [m.tobytes()], [high.tobytes()], [low.tobytes()]]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

        def blocks(ids: list[int], vectors: list[np.ndarray], end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, last_query, waiting
            part = task << 32 | made // part_blocks
            if ids:
                yield row(0, part, ids, vectors)
                for i, v in zip(ids, vectors, strict=True):
                    if i % every == 0 and i != last_query:
                        waiting[0].append(i)
                        waiting[1].append(v)
                        last_query = i
                made += 1
            if waiting[0] and (end or len(waiting[0]) >= CHUNK or made % part_blocks == 0):
                yield row(1, part, *waiting)
                waiting = ([], [])

        ids: list[int] = []
        vectors: list[np.ndarray] = []
        for b in batches:
            flat, at = b.column("v").flatten().to_numpy(zero_copy_only=False), b.column("v").offsets.to_numpy()
            at = at - at[0]
            for k, i in enumerate(b.column("vec_id").to_pylist()):
                ids.append(i)
                vectors.append(flat[at[k] : at[k + 1]])
                if len(ids) == block:
                    yield from blocks(ids, vectors, False)
                    ids, vectors = [], []
        yield from blocks(ids, vectors, True)

    return run


class Bounds:
    """The extremes of each component over some vectors."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.high, self.low = high, low
        self.most = float(max(np.abs(high).max(initial=0), np.abs(low).max(initial=0)))

    def exact(self, q: np.ndarray) -> bool:
        """Whether all sums with q are exact in doubles."""
        return self.most * float(np.abs(q).max(initial=0)) * max(len(q), 1) < _EXACT

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """At least the score of each query (row) with any of the vectors."""
        n = min(q.shape[1], len(self.high))
        x = q[:, :n]
        out = np.maximum(x, 0) @ self.high[:n] + np.minimum(x, 0) @ self.low[:n]
        return out if self.exact(q) else np.full(len(q), np.inf)


class Block(Bounds):
    """A block's forward index and its components' extremes."""

    def __init__(self, size: int, dim: int, ids: bytes, matrix: bytes, high: bytes, low: bytes):
        super().__init__(np.frombuffer(high), np.frombuffer(low))
        self.ids, self.matrix = np.frombuffer(ids, np.int64), np.frombuffer(matrix).reshape(size, dim)

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Scores of the queries (rows) with the block's vectors (columns); wrapped to 64 bits if beyond them."""
        n = min(q.shape[1], self.matrix.shape[1])
        if self.exact(q):
            return (q[:, :n] @ self.matrix[:, :n].T).astype(np.int64)
        whole = lambda m: np.array([[int(x) for x in r] for r in m[:, :n]], dtype=object).reshape(len(m), n)
        exact = whole(q) @ whole(self.matrix).T
        return np.array([[(int(x) + (1 << 63)) % (1 << 64) - (1 << 63) for x in r] for r in exact], np.int64).reshape(len(q), len(self.ids))


def search(blocks: list[Block], ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, vector ids, scores, blocks scored): the k best of each query in these blocks, ties to smaller ids.

    floors: scores that the kth of a query is known to reach; what is lower may be missing.
    """
    n = len(ids)
    best_s, best_i = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)
    kth = floors.astype(float)
    bounds = np.array([b.bounds(q) for b in blocks]).reshape(len(blocks), n)
    order = np.argsort(-bounds, axis=0, kind="stable")
    alive, scored = np.arange(n), 0
    for step in range(len(blocks)):
        at = order[step, alive]
        alive_ok = bounds[at, alive] >= kth[alive]  # later bounds of the others are lower still
        alive, at = alive[alive_ok], at[alive_ok]
        if not len(alive):
            break
        for j in np.unique(at):
            rows, b = alive[at == j], blocks[j]
            s = b.scores(q[rows])
            own = ids[rows, None] == b.ids[None, :]
            s_all = np.concatenate([best_s[rows], np.where(own, np.iinfo(np.int64).min, s)], axis=1)
            i_all = np.concatenate([best_i[rows], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(b.ids, s.shape))], axis=1)
            pick = np.lexsort((i_all, -s_all.astype(float) if np.abs(s_all[s_all > np.iinfo(np.int64).min]).max(initial=0) < _EXACT else ~s_all), axis=1)[:, :k]
            best_s[rows], best_i[rows] = np.take_along_axis(s_all, pick, 1), np.take_along_axis(i_all, pick, 1)
            full = best_i[rows, -1] != np.iinfo(np.int64).max
            kth[rows[full]] = np.maximum(kth[rows[full]], best_s[rows[full], -1].astype(float))
            scored += len(rows)
    real = best_i != np.iinfo(np.int64).max
    return np.repeat(ids, real.sum(axis=1)), best_i[real], best_s[real], scored


def _search_task(k: int) -> Callable:
    """Rows of a part come with its blocks (kind 0) before the query chunks (kind 1), which may bring their floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            for r in range(b.num_rows):
                p, kind, size, dim, ids, matrix, high, low, floors = (cols[c][r].as_py() for c in ("part", "kind", "size", "dim", "ids", "matrix", "high", "low", "floors"))
                if p != part:
                    part, blocks = p, []
                if kind == 0:
                    blocks.append(Block(size, dim, ids, matrix, high, low))
                    continue
                q_ids, q = np.frombuffer(ids, np.int64), np.frombuffer(matrix).reshape(size, dim)
                known = np.array([-np.inf if x is None else float(x) for x in floors]) if floors else np.full(size, -np.inf)
                qi, vi, s, _ = search(blocks, q_ids, q, known, k)
                yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int64()), pa.array(vi, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def extremes(index: DataFrame) -> DataFrame:
    """(part, dim, high, low) of the parts of an index; a part has PART_BLOCKS blocks at most."""

    def run(keys: tuple, t: pa.Table) -> pa.Table:
        dim = max(t["dim"].to_pylist())
        wide = lambda c: _padded([np.frombuffer(x) for x in t[c].to_pylist()], dim)
        return pa.table({"part": pa.array([keys[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()), "high": [wide("high").max(axis=0).tobytes()], "low": [wide("low").min(axis=0).tobytes()]})

    return index.where("kind = 0").select("part", "dim", "high", "low").groupBy("part").applyInArrow(run, "part long, dim int, high binary, low binary")


_ROUTED = "part long, kind int, size int, dim int, ids binary, matrix binary, high binary, low binary, floors array<long>"


def _route_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell come with its parts' extremes (kind 0) before the query chunks (kind 1): each chunk's queries by
    the part, other than their own, whose bound reaches their floor."""
    cell, parts = None, []
    names = [x.split()[0] for x in _ROUTED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64())]
    for b in batches:
        for r in b.to_pylist():
            if r["cell"] != cell:
                cell, parts = r["cell"], []
            if r["kind"] == 0:
                parts += [(p["part"], Bounds(np.frombuffer(p["high"]), np.frombuffer(p["low"]))) for p in r["parts"]]
                continue
            ids, q = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["matrix"]).reshape(r["size"], r["dim"])
            floors = np.array([-np.inf if x is None else float(x) for x in r["floors"]])
            rows = []
            for part, bound in parts:
                if part != r["part"]:
                    at = np.flatnonzero(bound.bounds(q) >= floors)
                    if len(at):
                        rows.append((part, 1, len(at), r["dim"], ids[at].tobytes(), q[at].tobytes(), b"", b"", [r["floors"][k] for k in at.tolist()]))
                if len(rows) >= 64 or (rows and part == parts[-1][0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []


def routed(extreme: DataFrame, chunks: DataFrame) -> DataFrame:
    """Query chunks (with floors) for the parts that they have to visit. Cells are rows of the parts' table by groups of
    chunks, as many as there are shuffle partitions at least, so that few rows of parts don't mean few tasks."""
    spark = chunks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    extreme = materialize(extreme, "extremes")
    rows = -(-extreme.count() // PARTS_A_ROW)
    groups = max(1, n // max(1, rows))
    packed = extreme.groupBy(F.pmod(F.xxhash64("part"), F.lit(max(1, rows))).alias("row")).agg(F.collect_list(F.struct("part", "high", "low")).alias("parts"))
    each = lambda of, k: F.explode(F.sequence(F.lit(0), F.lit(max(1, k) - 1))).alias(of)
    cell = (F.col("row") * groups + F.col("group")).alias("cell")
    a = packed.select("row", each("group", groups), "parts").select(cell, F.lit(0).alias("kind"), "parts")
    q = chunks.withColumn("group", F.pmod(F.xxhash64("part", "ids"), F.lit(groups))).select("*", each("row", rows))
    fields = ("part", "size", "dim", "ids", "matrix", "floors")
    both = a.unionByName(q.select(cell, F.lit(1).alias("kind"), *fields), allowMissingColumns=True)
    return both.repartition(n, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_route_task, _ROUTED)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row whose vec_id is divisible by `every`, over all other ids.

    Rows with null or non-finite components or a null id take no part. Shorter vectors count as padded with zeros.
    Repeated rows are candidates each, but none of a query with their id; a repeated query is answered once (by the
    row whose components come first). Ties go to the smaller id. Fewer candidates than k: all. An empty table gives no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = integers(vectors)
    index = v.repartitionByRange(n, "vec_id").sortWithinPartitions("vec_id", "v").mapInArrow(_index_task(every, block, part_blocks), _BLOCKS)
    index = materialize(index, "blocks")

    def searched(blocks_and_queries: DataFrame) -> DataFrame:
        return blocks_and_queries.repartition(n, "part").sortWithinPartitions("part", "kind").mapInArrow(_search_task(k), _FOUND)

    first = materialize(searched(index.withColumn("floors", F.lit(None).cast("array<long>"))), "own-part")
    # the kth score of each query in its own part, back at its chunk
    kth = _ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    chunks = index.where("kind = 1").withColumn("chunk", F.xxhash64("part", "ids"))
    own = chunks.select("chunk", F.posexplode(_ids_of("ids")).alias("pos", "query_id")).join(kth, "query_id", "left")
    floors = own.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "floor"))), lambda x: x["floor"]).alias("floors"))
    away = routed(extremes(index), chunks.join(floors, "chunk"))
    blocks = index.where("kind = 0").withColumn("floors", F.lit(None).cast("array<long>"))
    rest = searched(blocks.unionByName(away.select(*blocks.columns)))
    return _ranked(first.union(rest), k).select("query_id", "rank", "vec_id", "score")


def _ids_of(packed: str) -> F.Column:
    """The little-endian 64-bit ids in a binary column."""
    h = F.hex(F.col(packed))
    byte = lambda i, j: F.substr(h, (F.lit(8) * i + j) * 2 + 1, F.lit(2))
    one = lambda i: F.conv(F.concat(*[byte(i, j) for j in range(7, -1, -1)]), 16, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), (F.length(F.col(packed)) / 8).cast("int") - 1), one)
