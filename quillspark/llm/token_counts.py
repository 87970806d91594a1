"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays (see merging.py)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .arrow import CACHE_BYTES, cache_of, enter, entry_bytes, small_batches, texts_of
from .merging import MergeTable
from .pretokens import byte_level, spaced_pieces

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Token counts of texts; keeps the counts of pieces and pre-tokens in caches that empty themselves at a bound."""

    def __init__(self, tokenizer_file: str, pattern: str, limit: int = CACHE_BYTES):
        self.table, self.pattern, self.limit = MergeTable(tokenizer_file), pattern, limit
        self.pieces: dict[str, int] = {}  # of pieces that follow a blank
        self.held = 0
        specials = sorted(self.table.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def _words(self, words: list[str]) -> dict[str, int]:
        out = {}
        for part in (words[i : i + 20_000] for i in range(0, len(words), 20_000)):
            out.update(zip(part, self.table.merge([w.encode() for w in part])[0].tolist(), strict=True))
        return out

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text. A special token's string in a text is one token."""
        quick: list[list[str] | None] = []
        split: list[list[str]] = []  # pre-tokens of what is not quick, and of first pieces
        extra: list[int] = []
        for t in texts:
            found = self.special.findall(t) if self.special else []
            pieces = None if found else spaced_pieces(t)
            extra.append(len(found))
            quick.append(pieces)
            if pieces is not None:
                split.append(byte_level(pieces[0], self.pattern))
            else:
                parts = self.special.split(t) if found else [t]
                split.append([w for p in parts for w in byte_level(p, self.pattern)])
        wanted = set(chain.from_iterable(p[1:] for p in quick if p))
        if self.held > self.limit:
            self.pieces.clear()
            self.held = 0
        missing = {p: byte_level(" " + p, self.pattern) for p in wanted if p not in self.pieces}
        of = self._words(list({w for ws in chain(missing.values(), split) for w in ws}))
        for p, ws in missing.items():
            self.pieces[p] = sum([of[w] for w in ws])
            self.held += entry_bytes(p, 0)
        get = self.pieces.__getitem__
        return [n + sum([of[w] for w in ws]) + (sum(map(get, p[1:])) if p else 0) for n, ws, p in zip(extra, split, quick, strict=True)]


_counters: dict[tuple[str, str], Counter] = {}
cache_of("token counts", _counters.clear)


def _count_task(tokenizer_file: str, pattern: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token counts")
        key = (tokenizer_file, pattern)
        if key not in _counters:
            _counters[key] = Counter(*key)
        for b in small_batches(batches, "text"):
            texts = texts_of(b.column("text"))
            counts = _counters[key].count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, tokenizer_file: str, pattern: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    A null or empty text has no bytes and no tokens; a null doc_id stays null; repeated rows are counted each; an
    empty table gives no rows; further columns are ignored. No shuffle; a task holds some megabytes of text at once.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_count_task(tokenizer_file, pattern, limit), SCHEMA)
