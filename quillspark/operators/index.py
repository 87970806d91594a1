"""Inverted indexes as tables of postings."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..runtime import materialize, ship
from .analyze import Analyzer, ascii_words, block_words


def postings(docs: DataFrame, analyzer: Analyzer, key: str = "doc_id", text: str = "text", keys_differ: bool = False) -> DataFrame:
    """(term, key), each pair once. keys_differ: no two rows have the same key, so that equal pairs lie in one row and
    need no shuffle."""
    pairs = analyzer.terms(docs, key, text, once=True).select("term", key)
    return pairs if keys_differ and not analyzer.lemmas else pairs.distinct()


def listed(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, ids) of postings, ids in order. For display: a very frequent term has a very long list."""
    without = F.max(F.col(key).isNull().cast("int"))  # a set leaves out the null key, which counts
    lists = pairs.groupBy("term").agg(F.sort_array(F.collect_set(key)).alias("ids"), without.alias("without"))
    return lists.select("term", (F.size("ids") + F.col("without")).cast("long").alias("df"), "ids")


def vocabulary_size(pairs: DataFrame) -> DataFrame:
    """(vocab_size)."""
    return pairs.agg(F.count_distinct("term").alias("vocab_size"))


def positions(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """(field, term, key, pos) for every ASCII word of the fields; places start at 0 and count these words."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return docs.select(key, each.alias("f")).select(F.col("f.field").alias("field"), key, F.posexplode(ascii_words(F.col("f.value"))).alias("pos", "term")).select("field", "term", key, "pos")


def frequencies(places: DataFrame) -> DataFrame:
    """(term, freq): occurrences over all fields and documents."""
    return places.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def _place(key, seen: int = 0) -> tuple:
    """Where an id stands in Spark's order: null first, NaN last; then rows of equal ids."""
    return (0, 0, seen) if key is None else (2, 0, seen) if key != key else (1, key, seen)


def numbered(docs: DataFrame, per_block: int, key: str = "doc_id") -> DataFrame:
    """docs with block_id: `per_block` rows to a block, in the ids' order. Only ids are ranged and numbered, apart, and
    their ranges' sizes are summed, so that no task sees all rows; the driver holds each block's first id."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = materialize(docs.select(key).repartitionByRange(n, key).withColumn("__part", F.spark_partition_id()), "ranges")  # ranges drawn once
    sizes = ids.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    w = Window.partitionBy("__part").orderBy(key)
    at = ids.select(key, "__part", (F.row_number().over(w) - 1).alias("__at"), (F.row_number().over(w) - F.rank().over(w)).alias("__seen"))
    firsts = at.join(F.broadcast(before), "__part").where((F.col("__before") + F.col("__at")) % per_block == 0).select(key, "__seen").toArrow()
    starts = sorted(_place(*x) for x in zip(firsts.column(key).to_pylist(), firsts.column("__seen").to_pylist(), strict=True))

    @F.arrow_udf("long")
    def block(keys: pa.Array, seen: pa.Array) -> pa.Array:
        return pa.array([bisect_right(starts, _place(*x)) - 1 for x in zip(keys.to_pylist(), seen.to_pylist(), strict=True)], pa.int64())

    ship(spark)
    rows = docs.withColumn("__seen", F.lit(0))
    apart = firsts.filter(pc.greater(firsts.column("__seen"), 0)).select([key]).group_by(key).aggregate([])
    if apart.num_rows:  # rows of equal ids that lie in more than one block
        few = F.broadcast(spark.createDataFrame(apart).withColumnRenamed(key, "__apart"))
        each = F.row_number().over(Window.partitionBy(key).orderBy(key)) - 1
        rows = rows.join(few, docs[key].eqNullSafe(few["__apart"]), "left_anti").unionByName(docs.join(few, docs[key].eqNullSafe(few["__apart"]), "left_semi").withColumn("__seen", each))
    return rows.withColumn("block_id", block(key, "__seen")).drop("__seen")


#: Rows of a batch that an index gives at most.
_ROWS = 20_000


def block_index(docs: DataFrame, per_block: int = 10_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block_id, term, ids): each block's own index, ids in order. A block's texts go to one task, which indexes it in
    memory; no pair of term and id is shuffled."""

    def indexed(no: int, lists: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        terms = list(lists)
        for i in range(0, len(terms), _ROWS):
            part = terms[i : i + _ROWS]
            ids = [lists[t] for t in part]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(ids)), kind))
            yield pa.RecordBatch.from_arrays([pa.array([no] * len(part), pa.int64()), pa.array(part, pa.string()), found], ["block_id", "term", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, seen, lists, kind = None, None, set(), {}, None
        for b in batches:
            kind = b.schema.field(1).type
            for i in range(0, b.num_rows, 300):
                for no, k, t in zip(*(c.to_pylist() for c in b.slice(i, 300).columns), strict=True):
                    if no != now:
                        yield from indexed(now, lists, kind)
                        now, lists, seen = no, {}, set()
                    terms = block_words(t)
                    if seen and k == last:  # a row of the same id
                        terms -= seen
                        seen |= terms
                    else:
                        last, seen = k, terms
                    for w in terms:
                        if w in lists:
                            lists[w].append(k)
                        else:
                            lists[w] = [k]
        yield from indexed(now, lists, kind)

    ship(docs.sparkSession)
    d = numbered(docs.select(key, text), per_block, key).select("block_id", key, text)
    schema = StructType([StructField("block_id", LongType()), StructField("term", StringType()), StructField("ids", ArrayType(docs.schema[key].dataType))])
    return d.repartition("block_id").sortWithinPartitions("block_id", key).mapInArrow(run, schema)


def merge_lists(a: Column, b: Column) -> Column:
    """The sorted union of two posting lists."""
    return F.array_sort(F.array_union(a, b))


def _united(lists: pa.ListArray) -> pa.ListArray:
    """Lists with each value once, in order, null first."""
    ends, flat = np.asarray(lists.offsets), lists.values
    flat = flat.slice(ends[0], ends[-1] - ends[0])
    if pa.types.is_integer(flat.type) and not flat.null_count:
        v = flat.to_numpy()
        up = np.append(v[1:] > v[:-1], True)
        up[ends[1:][ends[1:] > ends[0]] - ends[0] - 1] = True
        if up.all():  # as blocks of ordered ids are
            return lists
    return pa.array([sorted(set(x), key=_place) for x in lists.to_pylist()], lists.type)


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """(term, df, ids) of all blocks. A term's lists come to a task in the blocks' order and are put together there."""
    ids = blocks.schema["ids"].dataType

    def merged(terms: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        lists = _united(lists)
        return pa.RecordBatch.from_arrays([terms, lists.value_lengths().cast(pa.int64()), lists], ["term", "df", "ids"])

    def whole(term: pa.Array, held: list[pa.Array]) -> pa.RecordBatch:
        flat = pa.concat_arrays(held)
        return merged(term, pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            terms, lists = b.column(0), b.column(1)
            first = np.flatnonzero(np.append(True, pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)))
            ends = np.append(np.asarray(lists.offsets)[first], lists.offsets[-1].as_py())
            terms, lists = terms.take(pa.array(first)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.values)
            if term is not None and term[0] == terms[0]:
                held.append(lists[0].values)
                if len(terms) == 1:
                    continue
                terms, lists = terms[1:], lists[1:]
            if term is not None:
                yield whole(term, held)
            if len(terms) > 1:
                yield merged(terms[:-1], lists[:-1])
            term, held = terms[-1:], [lists[-1].values]
        if term is not None:
            yield whole(term, held)

    ship(blocks.sparkSession)
    schema = StructType([StructField("term", StringType()), StructField("df", LongType()), StructField("ids", ids)])
    return blocks.repartition("term").sortWithinPartitions("term", "block_id").select("term", "ids").mapInArrow(run, schema)


def save(pairs: DataFrame, path: str) -> None:
    """Write postings sorted by term, so that row groups can be skipped by it."""
    pairs.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    """Postings that save() wrote; a missing index raises."""
    return spark.read.parquet(path)
