"""Packing of tokenized documents into sequences, balanced by estimated attention cost.

Documents are tokenized where they are read and packed there, window by window, so that no token crosses the
network: a task buffers whole documents until a window is full, gives each sequence of the window an estimated cost
(linear plus quadratic in the pieces' lengths, as attention is masked by document), and assigns the pieces in
descending order to the sequence with the lowest cost that still has the room. A piece that fits nowhere is cut over
the roomiest sequences. A window with fewer tokens than a multiple of the capacity hands its shortest documents to the
next one; what is left at the end of a task goes into sequences whose sizes are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .arrow import CACHE_BYTES, cache_of, enter, entry_bytes, small_batches
from .merging import MergeTable
from .pretokens import lower_words

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ID_BYTES = 4


def attention_cost(length: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> float:
    """Estimated cost of a piece: a linear part for the dense layers, a quadratic one for its own attention."""
    return linear * length + quadratic * length * length


def cost_balanced(lengths: list[int], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces (item, start, length, bin): items longer than the largest bin are cut at its size first; then every
    piece, in descending order, goes to the bin of lowest cost with room, or is cut over the roomiest bins.

    The sizes must sum to at least the lengths. Ties: the longer piece, then the earlier item, then the earlier bin.
    """
    most = max(sizes, default=0)
    pieces = []
    for item, n in enumerate(lengths):
        for at in range(0, n, most):
            pieces.append((-min(most, n - at), item, at))
    pieces.sort()
    room = list(sizes)
    by_cost = [(0.0, k) for k in range(len(sizes))]
    out: list[tuple[int, int, int, int]] = []
    cost = [0.0] * len(sizes)
    place = 0
    while place < len(pieces):
        neg, item, at = pieces[place]
        n = -neg
        place += 1
        skipped, found = [], -1
        while by_cost:
            c, k = heapq.heappop(by_cost)
            if c != cost[k] or not room[k]:
                continue
            if room[k] >= n:
                found = k
                break
            skipped.append((c, k))
            if len(skipped) >= 64:  # nearly full bins: look at all rooms once instead
                fits = [(cost[j], j) for j in range(len(sizes)) if room[j] >= n]
                found = min(fits)[1] if fits else -1
                break
        for x in skipped:
            heapq.heappush(by_cost, x)
        if found >= 0:
            room[found] -= n
            cost[found] += attention_cost(n)
            out.append((item, at, n, found))
            if room[found]:
                heapq.heappush(by_cost, (cost[found], found))
            continue
        rest = sorted((j for j in range(len(sizes)) if room[j]), key=lambda j: (-room[j], j))
        for j in rest:  # cut: it fits in no single bin
            take = min(n, room[j])
            room[j] -= take
            cost[j] += attention_cost(take)
            out.append((item, at, take, j))
            if room[j]:
                heapq.heappush(by_cost, (cost[j], j))
            at, n = at + take, n - take
            if not n:
                break
        if n:
            raise ValueError("the bins are smaller than the items")
    return out


def powers(n: int) -> list[int]:
    """n as powers of two, descending."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class ChunkCoder(dict):
    """Ids of white-space-free chunks, as little-endian unsigned 32-bit bytes; a cache that empties itself at a bound.

    White space ends every match of this tokenizer's splitter and no step of its normalizer looks across it, so a
    text's ids are those of its chunks, one after another.
    """

    def __init__(self, tokenizer_file: str, limit: int = CACHE_BYTES):
        super().__init__()
        from tokenizers import Tokenizer

        self.library, self.table, self.limit = Tokenizer.from_file(tokenizer_file), MergeTable(tokenizer_file), limit
        self.old, self.held = {}, 0
        self.library.no_truncation()
        self.library.no_padding()

    def fill(self, chunks: set[str]) -> None:
        """Make the ids of those chunks known."""
        if self.held > self.limit / 2:  # what the last two generations asked for stays
            self.old = dict(self)
            self.clear()
            self.held = 0
        missing = []
        for c in chunks:
            if c not in self:
                if c in self.old:
                    self[c] = self.old[c]
                    self.held += entry_bytes(c, self[c])
                else:
                    missing.append(c)
        special = re.compile("|".join(map(re.escape, self.table.specials))) if self.table.specials else None
        split = {}
        for c in missing:
            words = None if special and special.search(c) else lower_words(c)
            if words is None:
                self[c] = np.asarray(self.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                split[c] = words
        words = list({w for ws in split.values() for w in ws})
        coded = {}
        for part in (words[i : i + 20_000] for i in range(0, len(words), 20_000)):
            counts, ids = self.table.merge([w.encode() for w in part])
            raw, at = ids.astype("<u4").tobytes(), 0
            for w, n in zip(part, counts.tolist(), strict=True):
                coded[w] = raw[at : at + n * ID_BYTES]
                at += n * ID_BYTES
        for c, ws in split.items():
            self[c] = b"".join([coded[w] for w in ws])
        self.held += sum(entry_bytes(c, self[c]) for c in missing)


#: Kinds of bytes to the tokenizer's splitter; a chunk with an odd one is split as a string instead.
_OTHER, _LETTER, _NUMBER, _ODD = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _LETTER
_KIND[[*b"0123456789"]] = _NUMBER
_KIND[[*b"'", *range(128, 256)]] = _ODD
_LOWER = np.array([*bytes(range(256)).lower()], np.uint8)


def gathered(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of `pool` that begin at `starts`, one after another."""
    ends = np.cumsum(counts)
    return pool[np.repeat(starts - ends + counts, counts) + np.arange(int(counts.sum()))]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the ranges between neighbouring offsets."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


class BatchCoder:
    """Ids of whole batches of texts: each distinct chunk of a batch is split and merged once, in arrays.

    ASCII chunks without an apostrophe are split by the kinds of their bytes; the others go to a ChunkCoder.
    """

    def __init__(self, tokenizer_file: str, part: int = 20_000):
        self.odd, self.part = ChunkCoder(tokenizer_file), part
        self.table = self.odd.table
        self.special = "|".join(map(re.escape, self.table.specials))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and each text's number of them; a null text has none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = lists.flatten().dictionary_encode()
        pool, starts, counts = self._chunks(coded.dictionary)
        chunk = coded.indices.to_numpy()
        each = counts[chunk]
        return gathered(pool, starts[chunk], each), _sums(each, lists.offsets.to_numpy())

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks: an array of ids, where each chunk's begin, and how many they are."""
        n = len(chunks)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + n + 1].astype(np.int64)
        data = chunks.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        kind = _KIND[raw]
        odd = _sums(kind == _ODD, offsets) > 0
        if self.special:
            odd |= pc.match_substring_regex(chunks, self.special).to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        plain = np.repeat(~odd, sizes)
        pool, words = self._plain(_LOWER[raw[plain]], kind[plain], sizes[~odd])
        counts, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        counts[~odd] = words
        strange = chunks.filter(pa.array(odd)).to_pylist()
        self.odd.fill(set(strange))
        ids = [self.odd[c] for c in strange]
        counts[odd] = [len(x) // ID_BYTES for x in ids]
        for of in (~odd, odd):
            starts[of] = np.cumsum(counts[of]) - counts[of]
        starts[odd] += len(pool)
        return np.concatenate([pool, np.frombuffer(b"".join(ids), "<u4")]), starts, counts

    def _plain(self, raw: np.ndarray, kind: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of lower-case ASCII that lie one after another, and how many each has."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        begins = kind == _NUMBER  # every digit is a word
        begins[1:] |= kind[1:] != kind[:-1]
        begins[offsets[:-1][sizes > 0]] = True
        at = np.append(np.flatnonzero(begins), len(raw)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw)).dictionary_encode()
        ids, lengths = [], []
        for i in range(0, len(words.dictionary), self.part):
            part = words.dictionary[i : i + self.part]
            ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
            count, some = self.table.merge_flat(np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.diff(ends).astype(np.int64))
            ids.append(some.astype(np.uint32))
            lengths.append(count)
        length, word = np.concatenate(lengths), words.indices.to_numpy()
        each = length[word]
        return gathered(np.concatenate(ids), (np.cumsum(length) - length)[word], each), _sums(each, np.concatenate([[0], np.cumsum(begins)])[offsets])


_coders: dict[str, BatchCoder] = {}
cache_of("packing", _coders.clear)


def _pack_task(tokenizer_file: str, end_id: int, capacity: int, window_tokens: int, batch_bytes: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enter("packing")
        part = TaskContext.get().partitionId()
        if tokenizer_file not in _coders:
            _coders[tokenizer_file] = BatchCoder(tokenizer_file)
        coder, end = _coders[tokenizer_file], int(end_id).to_bytes(ID_BYTES, "little")
        held: list[tuple[int, bytes]] = []
        tokens, next_id = 0, part << 40

        def flush(last: bool):
            nonlocal held, tokens, next_id
            total = tokens
            sizes = [capacity] * (total // capacity)
            rest = total % capacity
            kept: list[tuple[int, bytes]] = []
            if rest and last:
                sizes += powers(rest)
            elif rest:  # whole short documents wait for the next window
                by_length = sorted(range(len(held)), key=lambda i: len(held[i][1]))
                waits, n = set(), 0
                for i in by_length:
                    if n >= rest:
                        break
                    waits.add(i)
                    n += len(held[i][1]) // ID_BYTES
                kept = [held[i] for i in range(len(held)) if i in waits]
                held = [x for i, x in enumerate(held) if i not in waits]
                total -= n
                sizes = [capacity] * -(-total // capacity)
                short = len(sizes) * capacity - total
                while short and kept:  # fill the gap that whole documents leave with a waiting one's first piece
                    held.append(kept.pop())
                    short = max(0, short - len(held[-1][1]) // ID_BYTES)
                total = sum(len(b) for _, b in held) // ID_BYTES
                sizes = [capacity] * -(-total // capacity)
                if total % capacity:
                    sizes[-1:] = powers(total % capacity)
            tokens = sum(len(b) for _, b in kept) // ID_BYTES
            placed = cost_balanced([len(b) // ID_BYTES for _, b in held], sizes)
            offsets = [0] * len(sizes)
            cols: list[list[int]] = [[] for _ in range(7)]
            for item, at, n, k in placed:
                doc, ids = held[item]
                row = (doc, at, n, zlib.crc32(ids[at * ID_BYTES : (at + n) * ID_BYTES]), len(ids) // ID_BYTES, next_id + k, offsets[k])
                offsets[k] += n
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            next_id += len(sizes)
            held = kept
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for b in small_batches(batches, "text", batch_bytes):
            coded, counts = coder.encode(b.column("text"))
            raw, at = coded.astype("<u4").tobytes(), 0
            for doc, n in zip(b.column("doc_id").to_pylist(), (counts * ID_BYTES).tolist(), strict=True):
                ids = raw[at : at + n] + end
                at += n
                held.append((doc, ids))
                tokens += len(ids) // ID_BYTES
                if tokens >= window_tokens:
                    yield flush(False)
        if held:
            yield flush(True)

    return run


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 1, capacity: int = 2048, window_tokens: int = 1 << 21) -> DataFrame:
    """Pack documents (doc_id, text; other columns are ignored) into sequences of at most `capacity` tokens.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is one end
    token; a null doc_id stays null; repeated rows are packed once each; an empty table gives no rows. A window holds
    `window_tokens` tokens besides its last document, which bounds a task's memory. No shuffle. sequence_id holds the
    number of the task in its upper bits, so that a task that runs again after a lost executor gives the same rows.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_pack_task(tokenizer_file, end_id, capacity, window_tokens), SCHEMA)
