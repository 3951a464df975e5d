"""Vectorised work on the UTF-8 bytes of an Arrow string column: words and 64-bit hashes of any byte range.

A range hash is a polynomial over random byte values, so the hash of every word, prefix, suffix or
substring of a whole batch comes from one running sum. Hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 500_000

_rng = np.random.Generator(np.random.PCG64(20240521))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Bytes:
    """The texts of a slice as one byte array, with their offsets; nulls are empty."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        _, ends, data = texts.buffers()
        n = len(texts)
        if n == 0 or ends is None:
            self.offsets = np.zeros(n + 1, dtype=np.int64)
        else:
            self.offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.raw = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, dtype=np.uint8)
        self.offsets = self.offsets - first
        self.data = LOWERED[self.raw] if lower else self.raw
        self._sums: np.ndarray | None = None

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of other bytes than space, and the first word's number of each text (with the count at the end)."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        solid = ~space[self.data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | cut[1:n]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | cut[1:n]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The 64-bit hash of each byte range."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data] * _power(_BASE, n), out=self._sums[1:])
        length = (ends - starts).astype(np.uint64)
        return mix((self._sums[ends] - self._sums[starts]) * _power(_INVERSE, n + 1)[starts] + length * np.uint64(0xD6E8FEB86659FD93))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about limit bytes together."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.diff(Bytes(batch.column(column)).offsets))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
