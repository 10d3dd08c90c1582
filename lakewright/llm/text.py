"""Vectorised word splitting and hashing over the UTF-8 buffers of Arrow batches.

Every function works on whole texts.  A batch is cut at document borders into pieces
of a few MB, so that memory depends on the piece (or on the longest document), never
on the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
_BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GRAM = np.uint64(0xD6E8FEB86659FD93)

#: Bytes of words: everything but space, tab, line feed, vertical tab, form feed, carriage return.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words: digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, _BLOCK + 1)
        inverse = pow(int(_BASE), -1, 2**64)
        _tables[:] = [_powers(size, int(_BASE)), _powers(size, inverse)]
    return _tables[0], _tables[1]


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every (non-overlapping, ascending) range."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        a = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[a]) * inverse[a]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) * _GRAM))


class Piece:
    """Some consecutive documents of a batch: their bytes and where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, member: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start byte, end byte) of every word, and the index of each document's first word (one more at the end)."""
        if lower:
            self.data = LOWER[self.data]
        inside = np.zeros(len(self.data) + 1, bool)
        inside[:-1] = member[self.data]
        before = np.zeros(len(self.data) + 1, bool)
        before[1:] = inside[:-1]
        before[self.offsets] = False  # words end at document borders
        starts = np.flatnonzero(inside & ~before)
        after = inside[:-1].copy()
        after[:-1] &= ~inside[1:-1]
        cut = self.offsets[1:]
        cut = cut[cut > 0] - 1
        after[cut] = inside[cut]
        ends = np.flatnonzero(after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, member: np.ndarray = NON_SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the index of each document's first word (one more at the end)."""
        starts, ends, first = self.words(member, lower)
        return hash_ranges(self.data, starts, ends), first


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cuts a string column (nulls as empty texts) into pieces of about `limit` bytes, whole documents each."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Piece(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words (len(words) - n + 1 of them; runs may cross document borders)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    count = len(words) - n + 1
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= _GRAM
        out += words[k : k + count]
    return mix(out + np.uint64(n))
