"""Vectorised words, lines and shingles of Arrow string batches (numpy only, no Spark).

A batch of texts is one byte array plus offsets. A byte range's hash is read off a prefix sum of
``T[byte] * P**position`` modulo 2**64, so that words, lines and windows of any length cost a few
array operations per byte, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # temporary arrays of a slice fit in a core's cache
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

#: White space of the word definition [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=_U)
    return _POWERS[0], _POWERS[1]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``codes[start:end]`` of 64-bit codes."""
    power, inverse = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(mix(codes) * power[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


class Texts:
    """The bytes of some texts; nulls count as empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.bytes = raw[offsets[0] : offsets[-1]]
        if lower:
            self.bytes = LOWER[self.bytes]
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def ranges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of True bytes within each text: starts, ends, and each text's first run."""
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ranges(~SPACE[self.bytes])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        power, inverse = _powers(len(self.bytes) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.bytes) + 1, _U)
            np.cumsum(_BYTE_CODES[self.bytes] * power[: len(self.bytes)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive entries, over the whole array."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, _U)
    for j in range(k):
        out = out * _U(0x9FB21C651E98DF25) + hashes[j : j + n]
    return mix(out)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    h = np.sort(hashes)
    keep = np.empty(len(h), bool)
    keep[:1] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes, A-Z lower-cased.

    A text of fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    texts = Texts(column, lower=True)
    starts, ends, first = texts.words()
    words = texts.hashes(starts, ends)
    runs = windows(words, k)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield distinct(runs[a : b - k + 1])
        elif b > a:
            yield windows(words[a:b], b - a)
        else:
            yield np.empty(0, _U)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds few bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset + 1 : text.offset + len(text) + 1]
    base = np.frombuffer(text.buffers()[1], np.int64)[text.offset]
    at = 0
    while at < len(ends):
        start = base if not at else ends[at - 1]
        to = max(at + 1, int(np.searchsorted(ends, start + size, side="right")))
        yield batch.slice(at, to - at)
        at = to
