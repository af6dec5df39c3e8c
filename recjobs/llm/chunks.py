"""Token ids of short strings, remembered; and gathering of runs of ids (numpy only, no Spark)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CACHE_BYTES = 32 << 20  # of strings and their ids that one store remembers
CHUNK_BYTES = 1 << 10  # longer strings aren't remembered


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all runs of these starts and lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class ChunkIds:
    """Ids of distinct strings by ``learn`` (strings -> all ids, and how many each has), each asked for
    once while it is remembered. What is held is bounded in bytes; beyond that the store starts anew."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = CACHE_BYTES):
        self.learn, self.most = learn, most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.bytes = 0

    def gather(self, chunks: list[str], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``chunks[code]`` one after the other, and how many each has; ``chunks`` are distinct."""
        if self.bytes > self.most:
            self._forget()
        at = np.array([self.known.get(c, -1) for c in chunks], np.int64)
        new = np.flatnonzero(at < 0)
        words = [chunks[i] for i in new.tolist()]
        ids, n = self.learn(words)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.ids = np.concatenate([self.ids, ids])
        at[new] = np.arange(len(self.starts) - len(n), len(self.starts))
        self.known.update((w, k) for w, k in zip(words, at[new].tolist()) if len(w) <= CHUNK_BYTES)
        self.bytes += sum(map(len, words)) + 140 * len(words) + 4 * int(n.sum())
        where = at[code]
        n = self.lengths[where]
        return self.ids[ragged(self.starts[where], n)], n


def flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and how many each list has."""
    return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)


def counts_of(lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``lengths`` between ``offsets`` (of texts among their chunks)."""
    return np.diff(np.concatenate([[0], np.cumsum(lengths)])[offsets])
