"""Rank-synchronous byte-pair merging over ragged numpy arrays.

Pre-tokens are held as one flat array of symbols with the place where each begins. In every round each pre-token's
lowest-rank pair is merged at all its places at once; pre-tokens without a pair leave the arrays. A merge can only
make pairs that come later in the table (checked on loading), so this gives what merging one pair at a time gives.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.iinfo(np.int32).max
_SLOTS = 1 << 19


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    extra = 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return out


class MergeTable:
    """The merges of a tokenizer's JSON file: pairs of symbol ids to rank and merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made: dict[int, int] = {}
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        for rank, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), new.tolist(), strict=True)):
            if max(made.get(a, -1), made.get(b, -1)) >= rank or made.setdefault(c, rank) != rank:
                raise ValueError("a merge comes before the merges of its parts")
        self._build(left << 20 | right, new)

    def _build(self, keys: np.ndarray, new: np.ndarray) -> None:
        """Two tables of slots; what finds both of its slots taken goes to a sorted rest."""
        self.new = np.append(new, 0)
        none = np.int64(-1)
        ranks = np.arange(len(keys), dtype=np.int32)
        self.slot_keys, self.slot_ranks = [], []
        for shift in (27, 23):
            slot = self._slot(keys, shift)
            _, keep = np.unique(slot, return_index=True)
            k, r = np.full(_SLOTS, none), np.full(_SLOTS, NONE, np.int32)
            k[slot[keep]], r[slot[keep]] = keys[keep], ranks[keep]
            self.slot_keys.append(k)
            self.slot_ranks.append(r)
            rest = np.ones(len(keys), bool)
            rest[keep] = False
            keys, ranks = keys[rest], ranks[rest]
        order = np.argsort(keys)
        self.rest_keys, self.rest_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(ranks[order], NONE)

    @staticmethod
    def _slot(keys: np.ndarray, shift: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 19 - (27 - shift))).astype(np.int64) & (_SLOTS - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is no merge."""
        keys = left << 20 | right
        slot = self._slot(keys, 27)
        out = np.where(self.slot_keys[0][slot] == keys, self.slot_ranks[0][slot], NONE)
        slot = self._slot(keys, 23)
        np.copyto(out, self.slot_ranks[1][slot], where=self.slot_keys[1][slot] == keys)
        if len(self.rest_keys) > 1:
            at = np.searchsorted(self.rest_keys, keys)
            np.copyto(out, self.rest_ranks[at], where=self.rest_keys[at] == keys)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that survive in each word (int64 counts), and all of them, word after word. Words aren't empty."""
        return self.merge_flat(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def merge_flat(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that lie one after another in an array of bytes."""
        n = len(sizes)
        symbols = self.first[raw]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        counts = np.zeros(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # words, their symbols
        ids = np.arange(n)
        rank = np.full(len(symbols), NONE, np.int32)  # of the pair that begins at a symbol
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[ends - 1] = NONE
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            live = low != NONE
            if not live.all():
                of = np.repeat(live, sizes)
                counts[ids[~live]] = sizes[~live]
                done.append((ids[~live], symbols[~of]))
                ids, sizes, low, symbols, rank = ids[live], sizes[live], low[live], symbols[of], rank[of]
                if not len(ids):
                    break
            hit = rank == np.repeat(low, sizes)
            at = np.flatnonzero(hit)
            near = np.flatnonzero(np.diff(at) == 1)
            if len(near):  # overlapping places of a pair of equal symbols: every other one, from the left
                run = np.arange(len(at))
                fresh = np.ones(len(at), bool)
                fresh[near + 1] = False
                begin = np.maximum.accumulate(np.where(fresh, run, 0))
                at = at[(run - begin) % 2 == 0]
            symbols[at] = self.new[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            word = np.repeat(np.arange(len(ids)), sizes)
            sizes = sizes - np.bincount(word[at], minlength=len(ids))
            place = np.cumsum(keep) - 1
            symbols, rank = symbols[keep], rank[keep]
            at = place[at]
            ends = np.cumsum(sizes) - 1
            final = np.zeros(len(symbols), bool)
            final[ends] = True
            again = np.concatenate([at, at[at > 0] - 1])
            again = again[~final[again]]
            rank[at] = NONE
            if len(again):
                rank[again] = self.ranks(symbols[again], symbols[again + 1])
        if not done:
            return counts, np.zeros(0, np.int64)
        order = np.concatenate([w for w, _ in done])
        flat = np.concatenate([s for _, s in done])
        begin = np.zeros(n, np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        starts = np.cumsum(counts) - counts
        take = np.repeat(begin - starts, counts) + np.arange(int(counts.sum()))
        return counts, flat[take]
