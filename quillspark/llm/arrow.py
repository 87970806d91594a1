"""Helpers for Arrow-batched operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401


#: Bytes that a cache of a worker holds at most, over two generations.
CACHE_BYTES = 96 << 20
#: What an entry takes besides its key and value.
_ENTRY = 100
_caches: list[tuple[str, Callable[[], None]]] = []
_running = ""


def cache_of(owner: str, forget: Callable[[], None]) -> None:
    """Name the function that empties an operator's caches."""
    _caches.append((owner, forget))


def enter(owner: str) -> None:
    """Called where an operator's task begins. Workers are reused: what other operators cached goes back to the system."""
    global _running
    if _running == owner:
        return
    _running = owner
    for name, forget in _caches:
        if name != owner:
            forget()
    gc.collect()
    give_back()


def give_back() -> None:
    """Hand freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def entry_bytes(key, value) -> int:
    """About what an entry of a cache takes."""
    return sys.getsizeof(key) + sys.getsizeof(value) + _ENTRY


class Memo(dict):
    """A cache that computes what it lacks and holds what its last two generations asked for; never changes a result."""

    def __init__(self, make, limit: int = CACHE_BYTES, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.held = make, limit, longest, 0
        self.old: dict = {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= self.longest:
            if self.held > self.limit / 2:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self.held += entry_bytes(key, out)
            self[key] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.old, self.held = {}, 0


def small_batches(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about max_bytes of text each (one row at least)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, s in enumerate(sizes):
            if total + s > max_bytes and i > start:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(s)
        yield b.slice(start, n - start)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column, "" for null."""
    return [x or "" for x in column.to_pylist()]
