"""Byte-level BPE encoding and decoding, folded in Spark's higher-order functions.

A text is split by the tokenizer's pattern. A word's bytes become an array of symbols, and a fold over it merges the
pair of lowest rank, step by step; ranks come from a literal map of pairs.

Distinct words are counted over all documents, and the most frequent of them (a bounded number) are folded once: with
their ids they are a dictionary that is broadcast to the words of the texts, which only saves time. Every other word is
folded where it stands, so no token is shuffled. Words stay in their partition and order, in which a task puts a text's
ids together again; their places are checked. Decoding concatenates the binary pieces of the ids.

Literal maps are perfect hash tables: arrays with a displacement per bucket, looked up in constant time. They are the
value of a scalar subquery, so that plans stay small; a projection of its own holds it until Spark merges it with the
one that uses it, as the analyzer takes no subquery inside a higher-order function.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, ship
from .arrow import enter
from .rules import let

#: An element of the fold's state: rank of the pair that begins here, the place in the word, the symbol.
_SYMBOL, _PLACE = 1 << 17, 1 << 24
_RANK = _SYMBOL * _PLACE
NO_RANK = 1 << 16
#: Words of more bytes are merged at all places of the lowest pair at once, if the ranks allow it (in_order()).
LONG_WORD = 1 << 14
_BUCKETS = 65_521


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ids."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    with fs.open_input_stream(name) as f:
        lines = f.read().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by merging the leftmost pair of lowest rank until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [(ranks.get(a + b, NO_RANK), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(found)
        if rank == NO_RANK:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def displaced(slots: np.ndarray, buckets: np.ndarray, size: int) -> np.ndarray:
    """Displacements by bucket such that (slots + displacement of the bucket) mod size differ for all keys."""
    out = np.zeros(_BUCKETS, np.int64)
    used = np.zeros(size, bool)
    order = np.argsort(buckets, kind="stable")
    b, s = buckets[order], slots[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(b)])
    hop = 0
    for k in np.argsort(-sizes, kind="stable"):
        own = s[starts[k] : starts[k] + sizes[k]]
        if sizes[k] > 1 and len(np.unique(own % size)) < sizes[k]:
            raise ValueError("two keys of a bucket share a slot")
        for _ in range(size):
            hop = (hop + 7_331) % size
            at = (own + hop) % size
            if not used[at].any():
                used[at] = True
                out[b[starts[k]]] = hop
                break
        else:
            raise ValueError("the table is too small")
    return out


def _sized(n: int) -> int:
    """An odd size with room for n keys."""
    return max(31, 3 * n // 2 | 1)


def _literals(spark: SparkSession, **arrays) -> Column:
    """Arrays as the fields of one literal struct."""
    made = {k: pa.array(v, pa.int64()) for k, v in arrays.items()}
    one = {k: pa.ListArray.from_arrays([0, len(v)], v) for k, v in made.items()}
    row = pa.StructArray.from_arrays(list(one.values()), names=list(one))
    return spark.createDataFrame(pa.table({"literals": row})).select("literals").scalar()


def _bound(tables: Column, names: str, use) -> Column:
    """use(one column for each of the named arrays), each bound once."""

    def bind(struct: Column, left: list[str], found: list[Column]) -> Column:
        return let(struct[left[0]], lambda x: bind(struct, left[1:], [*found, x])) if left else use(*found)

    return let(tables, lambda struct: bind(struct, names.split(), []))


@lru_cache(maxsize=4)
def in_order(path: str) -> bool:
    """Whether every token comes after two others that make it. Then merging a pair makes no pair of a lower rank where
    that pair's own parts weren't merged before, and all its places can be merged at once."""
    ranks = ranks_of(path)
    before = lambda part, r: len(part) == 1 or ranks.get(part, r) < r
    return all(len(t) < 2 or any(before(t[:k], r) and before(t[k:], r) for k in range(1, len(t))) for t, r in ranks.items())


@lru_cache(maxsize=4)
def _pair_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, table) of all pairs of tokens whose concatenation is a token: an entry is the pair and its rank."""
    ranks = ranks_of(path)
    if max(ranks.values(), default=0) >= NO_RANK:
        raise ValueError("ids of at most 16 bits are supported")
    found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    a, b, r = np.array(found, np.int64).reshape(-1, 3).T
    keys = a * NO_RANK + b
    for size in range(_sized(len(a)), _sized(len(a)) + 2_000, 2):
        try:
            d = displaced(keys, keys % _BUCKETS, size)
            break
        except ValueError:
            continue
    table = np.full(size, -1, np.int64)
    table[(keys + d[keys % _BUCKETS]) % size] = keys * _SYMBOL + r
    return d, table


class Coder:
    """Expressions of a rank file's tokenizer."""

    def __init__(self, rank_file: str, pattern: str):
        self.file, self.pattern = rank_file, "(?U)" + pattern
        self.ranks = ranks_of(rank_file)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def split(self, text: Column) -> Column:
        """All matches of the pattern; null and empty texts have none."""
        return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(self.pattern), F.lit(0))

    # ---- folding

    def _folded(self, word: Column, t: Column, d: Column, single: Column, size: int) -> Column:
        """The ids of a word."""
        none = NO_RANK * _RANK
        sym = lambda x: x.bitwiseAND(F.lit(_SYMBOL - 1))

        def element(key: Column, low: Column) -> Column:
            """What stands for a symbol: the rank of its pair (by the pair's key, null at the end) over place and symbol."""
            slot = F.pmod(key + F.get(d, F.pmod(key, F.lit(_BUCKETS)).cast("int")), F.lit(size)).cast("int")
            # another pair's entry is far from this pair's, so that the distance is no rank
            rank = F.least(F.abs(F.get(t, slot) - key * _SYMBOL), F.lit(NO_RANK))
            return F.coalesce(rank * _RANK, F.lit(none)) + low

        def begin(symbols: Column) -> Column:
            keys = F.zip_with(symbols, F.slice(symbols, F.lit(2), F.size(symbols)), lambda a, b: a * NO_RANK + b)
            lows = F.transform(symbols, lambda x, i: i.cast("bigint").bitwiseAND(F.lit(_PLACE - 1)) * _SYMBOL + x)
            return F.zip_with(keys, lows, element)

        def merged(s: Column, m: Column, i: Column) -> Column:
            c, before = F.shiftright(m, 41), F.get(s, i - 2)
            new_key, new_low = c * NO_RANK + sym(F.get(s, i + 1)), m.bitwiseAND(F.lit((_PLACE - 1) * _SYMBOL)) + c
            new = lambda ks, ls: F.zip_with(F.array(*ks), F.array(*ls), element)
            rest = F.slice(s, i + 2, F.size(s))
            two = new([sym(before) * NO_RANK + c, new_key], [before.bitwiseAND(F.lit(_RANK - 1)), new_low])
            return F.when(i > 1, F.concat(F.slice(s, F.lit(1), i - 2), two, rest)).otherwise(F.concat(new([new_key], [new_low]), rest))

        def one(s: Column) -> Column:
            apply = lambda m: F.when(m < none, let(F.array_position(s, m).cast("int"), lambda i: merged(s, m, i))).otherwise(s)
            return let(F.array_min(s), apply)

        def everywhere(s: Column) -> Column:
            """All places of the lowest pair, every other one where they overlap. State: rank and symbol only."""
            plain = F.transform(s, lambda x: sym(x))

            def at(low: Column) -> Column:
                hits = F.array_join(F.transform(s, lambda x: F.when(F.shiftright(x, 41) == low, "1").otherwise("0")), "")
                taken = F.transform(F.split(F.regexp_replace(hits, "11", "10"), ""), lambda c: c == "1")
                with_new = lambda r: F.filter(
                    F.transform(plain, lambda x, i: F.when(F.get(r, i), low).when(F.coalesce(F.get(r, i - 1), F.lit(False)), F.lit(-1)).otherwise(x)), lambda x: x >= 0
                )
                return let(taken, lambda r: let(with_new(r), begin))

            return let(F.shiftright(F.array_min(s), 41), at)

        def with_least(s: Column) -> Column:
            return F.struct(s.alias("s"), F.array_min(s).alias("m"))

        as_latin = F.decode(F.to_binary(word, F.lit("utf-8")), "ISO-8859-1")  # a character for a byte
        latin = F.when(F.octet_length(word) == F.char_length(word), word).otherwise(as_latin)
        symbols = F.transform(F.split(latin, ""), lambda c: F.get(single, F.ascii(c)))

        def out(s: Column) -> Column:
            steps = F.sequence(F.lit(2), F.size(s))
            short = F.aggregate(steps, s, lambda acc, _: one(acc))
            # two loops of the root of the size: what is done passes few steps, as each one copies the state
            some = F.sequence(F.lit(1), F.ceil(F.sqrt(F.size(s).cast("double"))))
            step = lambda acc, _: F.when(acc["m"] < none, let(everywhere(acc["s"]), with_least)).otherwise(acc)
            long = F.aggregate(some, with_least(s), lambda acc, _: F.when(acc["m"] < none, F.aggregate(some, acc, step)).otherwise(acc), lambda acc: acc["s"])
            done = F.when(F.size(s) < 2, s).when(F.size(s) <= LONG_WORD, short).otherwise(long) if in_order(self.file) else F.when(F.size(s) < 2, s).otherwise(short)
            return F.transform(done, lambda x: sym(x).cast("int"))

        return let(let(symbols, begin), out)

    def fold(self, word: Column, tables: Column) -> Column:
        """The ids of one word, joined by blanks."""
        return F.array_join(self.folded(word, tables).cast("array<string>"), " ")

    def folded(self, word: Column, tables: Column) -> Column:
        """The ids of one word."""
        return _bound(tables, "pairs shifts single", lambda t, d, x: self._folded(word, t, d, x, len(_pair_tables(self.file)[1])))

    def tables(self, spark: SparkSession) -> Column:
        """The literal maps of the fold."""
        d, t = _pair_tables(self.file)
        return _literals(spark, pairs=t, shifts=d, single=self.bytes)

    # ---- the dictionary

    def dictionary(self, docs: DataFrame, most_words: int = 800_000) -> DataFrame:
        """(word, ids): the most frequent words of all documents, folded once: at most `most_words`, of 64 bytes at
        most, and the tokens that merging doesn't lead to. A word comes once."""
        spark = docs.sparkSession
        w = docs.select(F.explode(self.split(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        w = materialize(w.where(F.octet_length("word") <= 64), "word-counts")
        level = F.floor(F.log2(F.col("n").cast("double")) * 16)
        levels = sorted(((r[0], r[1]) for r in w.groupBy(level.alias("l")).count().collect()), reverse=True)
        total, least = 0, None
        for lv, n in levels:
            if total + n > most_words:
                break
            total, least = total + n, lv
        top = w.where(level >= least if least is not None else F.lit(False))
        whole = [(word, [r]) for word, r in unmerged(self.file)]
        if whole:
            top = top.where(~F.col("word").isin([x for x, _ in whole]))
        top = top.select("word", self.tables(spark).alias("__tables")).select("word", self.folded(F.col("word"), F.col("__tables")).alias("ids"))
        if whole:
            top = top.unionByName(spark.createDataFrame(whole, "word string, ids array<int>"))
        return materialize(top, "dictionary")

    def words(self, docs: DataFrame, most_words: int) -> DataFrame:
        """(doc_id, pos, ids): a row per word of each text, in order; one without pos and ids for a text without words."""
        spark = docs.sparkSession
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode_outer(self.split(F.col("text"))).alias("pos", "word"))
        d = d.join(F.broadcast(self.dictionary(docs, most_words)), "word", "left")
        d = d.select("doc_id", "pos", "word", "ids", self.tables(spark).alias("__tables"))
        return d.select("doc_id", "pos", F.coalesce("ids", self.folded(F.col("word"), F.col("__tables"))).alias("ids"))


@lru_cache(maxsize=4)
def unmerged(path: str) -> list[tuple[str, int]]:
    """Words that are tokens, and have their ids, though merging doesn't lead there."""
    ranks = ranks_of(path)
    texts = ((t, t.decode("utf-8", "ignore"), r) for t, r in ranks.items())
    return [(x, r) for t, x, r in texts if x.encode() == t and merge_bytes(t, ranks) != [r]]


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[pa.Array, pa.Array]:
    """By id: its bytes, and a blank with its decimal digits."""
    ranks = ranks_of(path)
    made = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, r in ranks.items():
        made[r] = token
    return pa.array(made, pa.large_binary()), pa.array([b" %d" % i for i in range(len(made))], pa.large_binary())


def _joined(pieces: pa.Array, ids: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The pieces of ids in one buffer, and where each begins and the last ends."""
    x = pieces.take(ids)
    offsets, data = x.buffers()[1:]
    return memoryview(data or b""), np.frombuffer(offsets, np.int64, len(x) + 1, x.offset * 8) if len(x) else np.zeros(1, np.int64)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Of each batch of words(): [(doc_id, whether a text begins here, first and last place among the ids)], and the ids."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        pos = b.column("pos").fill_null(0).to_numpy()
        due = np.r_[pos[0] if last is None else last + 1, pos[:-1] + 1]
        if (last is None and pos[0]) or ((pos != due) & (pos != 0)).any():
            raise ValueError("the words of a text are not in order")
        last = int(pos[-1])
        ids = b.column("ids")
        ends = np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)]
        starts = np.flatnonzero(pos == 0)
        rows = starts if len(starts) and starts[0] == 0 else np.r_[0, starts]
        docs = b.column("doc_id").take(pa.array(rows)).to_pylist()
        stops = np.r_[rows[1:], len(pos)]
        yield list(zip(docs, (pos[rows] == 0).tolist(), ends[rows].tolist(), ends[stops].tolist(), strict=True)), ids.flatten()


def encode(docs: DataFrame, rank_file: str, pattern: str, most_words: int = 800_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids (array<int>), decoded (binary: the text's bytes, from the ids).

    Null and empty texts have no ids. Repeated rows are encoded each; other columns are ignored; an empty table gives
    no rows; a null doc_id stays. A task holds the ids of one text and of one batch of words.
    """
    ship(docs.sparkSession)

    def whole(batches):
        enter("byte_bpe")
        pieces, held = _pieces(rank_file)[0], None

        def row(doc, parts):
            ids = pa.concat_arrays(parts)
            data = _joined(pieces, ids)[0]
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([data.tobytes()], pa.binary())], ["doc_id", "ids", "decoded"])

        for found, ids in _stretches(batches):
            for doc, begins, a, z in found:
                if begins:
                    if held:
                        yield row(*held)
                    held = (doc, [])
                held[1].append(ids.slice(a, z - a))
        if held:
            yield row(*held)

    return Coder(rank_file, pattern).words(docs, most_words).mapInArrow(whole, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, rank_file: str, pattern: str, most_words: int = 800_000) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by blanks), decoded_sha256; see encode().
    A task holds one batch of words, however long a text is."""
    ship(docs.sparkSession)

    def hashed(batches):
        enter("byte_bpe")
        pieces, decimals = _pieces(rank_file)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        held = None

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names)

        def closed(doc, n, of_ids, of_bytes):
            return doc, n, of_ids.hexdigest(), of_bytes.hexdigest()

        for found, ids in _stretches(batches):
            (data, at), (text, text_at) = _joined(pieces, ids), _joined(decimals, ids)
            done = []
            for doc, begins, a, z in found:
                if begins:
                    if held:
                        done.append(closed(*held))
                    held = [doc, 0, hashlib.sha256(), hashlib.sha256()]
                if a < z:
                    held[2].update(text[text_at[a] + (held[1] == 0) : text_at[z]])
                    held[3].update(data[at[a] : at[z]])
                    held[1] += z - a
            if done:
                yield rows(done)
        if held:
            yield rows([closed(*held)])

    return Coder(rank_file, pattern).words(docs, most_words).mapInArrow(hashed, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
