"""A bounded store of id sequences by word, for encoders whose words are independent."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordStore:
    """Encodes lists of words, calling ``encode`` once for each distinct word not in the store.

    A store of more than ``limit`` words keeps those met in more than one call, or
    none where those are over half the limit, so a worker's memory is bounded.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], kind: pa.DataType, limit: int = 400_000):
        self.encode, self.kind, self.limit = encode, kind, limit
        self._clear()

    def _clear(self) -> None:
        self.slot: dict = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _shrink(self) -> None:
        again = self.met > 1
        if again.sum() * 2 > self.limit:
            self._clear()
            return
        kept = np.flatnonzero(again)
        slot = np.cumsum(again) - 1
        self.slot = {w: int(slot[i]) for w, i in self.slot.items() if again[i]}
        flat = self.ids[runs(self.start[kept], self.size[kept])]
        self.size, self.met = self.size[kept], np.ones(len(kept), np.int32)
        self.start, self.used = np.cumsum(self.size) - self.size, len(flat)
        self.ids = np.concatenate([flat, np.zeros(1 << 16, np.uint32)])

    def __call__(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and the number of ids of each word."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.slot) > self.limit:
            self._shrink()
        coded = pa.array(words, self.kind).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slots = [self.slot.get(w, -1) for w in distinct]
        missing = [w for w, s in zip(distinct, slots) if s < 0]
        if missing:
            flat, counts = self.encode(missing)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            base = len(self.start)
            self.start = np.concatenate([self.start, self.used + np.cumsum(counts) - counts])
            self.size = np.concatenate([self.size, counts])
            self.met = np.concatenate([self.met, np.zeros(len(counts), np.int32)])
            self.used += len(flat)
            self.slot.update((w, base + i) for i, w in enumerate(missing))
            slots = [self.slot[w] for w in distinct]
        slots = np.array(slots, np.int64)
        self.met[slots] += 1
        of = slots[coded.indices.to_numpy()]
        sizes = self.size[of]
        return self.ids[runs(self.start[of], sizes)], sizes


def per_text(sizes: np.ndarray, words_of: list[int]) -> np.ndarray:
    """Ids of each text, from the ids of each word and the number of words of each text."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(words_of)
    return total[ends] - total[ends - np.array(words_of, np.int64)] if len(words_of) else np.zeros(0, np.int64)
