"""Words of an Arrow string column as flat numpy arrays of 64-bit hashes.

A batch is walked in slices of about half a megabyte of text, so temporaries stay small
however many or long the texts are (one text is never cut).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit integers over the whole range."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _GOLD * np.uint64(2 * seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_power = mix(np.arange(256, dtype=np.uint64), 7) | np.uint64(1)


def multipliers(n: int) -> np.ndarray:
    """One random odd multiplier for each position in a word."""
    global _power
    if n > len(_power):
        _power = mix(np.arange(max(n, 2 * len(_power)), dtype=np.uint64), 7) | np.uint64(1)
    return _power


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library; there it is left alone
    _LIBC = None


def _separators(letters_only: bool) -> np.ndarray:
    sep = np.zeros(256, bool)
    sep[[9, 10, 11, 12, 13, 32]] = True
    if letters_only:
        sep[:128] = True
        for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
            sep[ord(a) : ord(b) + 1] = False
    return sep


_SEP = {k: _separators(k) for k in (False, True)}
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


@dataclass
class Words:
    """rows: first and last+1 row of the slice; data: lower-cased bytes; start, end: of each
    word in data; row: of each word, counted from rows[0]; count: words of each row."""

    rows: tuple[int, int]
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    count: np.ndarray
    text: pa.Array

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``prefix`` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        size = end - self.start
        first = np.cumsum(size) - size
        pos = np.arange(size.sum()) - np.repeat(first, size)
        chars = self.data[np.repeat(self.start, size) + pos].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(multipliers(int(size.max()))[pos] * chars, first)
        return mix(h, 1 if prefix is None else 2 + prefix)


def words(col: pa.Array, letters_only: bool = False, latin: bool = False, lower: bool = True, size: int = SLICE_BYTES) -> Iterator[Words]:
    """Slices of ``col`` (null: empty) of about ``size`` bytes, split at blank, tab, LF, VT, FF, CR, or with
    ``letters_only`` at every ASCII character but letters and digits. A-Z are lower-cased
    (unless not ``lower``), with ``latin`` also the two-byte letters from U+00C0 to U+00DE."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.fill_null("").cast(pa.large_string())
    if not len(col):
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        own, bounds = (_LOW[data[off[lo] : off[hi]]] if lower else data[off[lo] : off[hi]]), off[lo : hi + 1] - off[lo]
        if latin and len(own) > 1:
            lead = np.flatnonzero(own[:-1] == 0xC3) + 1
            lead = lead[(own[lead] >= 0x80) & (own[lead] <= 0x9E) & (own[lead] != 0x97)]
            own[lead] += 32
        word = np.concatenate([[False], ~_SEP[letters_only][own], [False]])
        cut = np.zeros(len(own) + 1, bool)
        cut[bounds] = True
        start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
        end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
        row = np.searchsorted(bounds, start, "right") - 1
        yield Words((lo, hi), own, start, end, row, np.bincount(row, minlength=hi - lo), col[lo:hi])
        lo = hi
    give_back()


def give_back() -> None:
    """Return freed memory to the system, as a Python worker lives on through later stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def run_starts(counts: np.ndarray) -> np.ndarray:
    """Offset of each row's first item."""
    return np.cumsum(counts) - counts
