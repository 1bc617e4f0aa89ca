"""Monotone integer sequences in Elias-Fano form, read in place by many positions at a time."""

from __future__ import annotations

import numpy as np

from basketry.llm._text import U64

_SIX = [(32, U64(0xFFFFFFFF)), (16, U64(0xFFFF)), (8, U64(0xFF)), (4, U64(0xF)), (2, U64(0x3)), (1, U64(0x1))]

def encode(values: np.ndarray) -> bytes:
    """Lower bits packed, upper bits in unary, and the ones and zeros before each word of these."""
    values = np.asarray(values, U64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(1, n)).bit_length() - 1) if n else 0
    upper = (values >> U64(low)).astype(np.int64) + np.arange(n)
    words = (int(upper[-1]) if n else 0) // 64 + 2
    high = np.zeros(words, U64)
    np.bitwise_or.at(high, upper >> 6, U64(1) << (upper & 63).astype(U64))
    packed = np.zeros(n * low // 64 + 2, U64)
    if low:
        part, at = values & U64((1 << low) - 1), np.arange(n, dtype=np.int64) * low
        shift = (at & 63).astype(U64)
        np.bitwise_or.at(packed, at >> 6, part << shift)
        over = (at & 63) + low > 64
        np.bitwise_or.at(packed, (at[over] >> 6) + 1, part[over] >> (U64(64) - shift[over]))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
    zeros = np.arange(len(ones)) * 64 - ones
    head = np.array([n, low, len(packed), words, len(ones)], U64)
    return b"".join(x.tobytes() for x in (head, packed, high, ones.astype(U64), zeros.astype(U64)))


class EliasFano:
    """A view of encoded bytes: nothing is unpacked but what is asked for."""

    def __init__(self, words: np.ndarray):
        self.n, self.low, a, b, c = (int(x) for x in words[:5])
        self.packed, self.high = words[5 : 5 + a], words[5 + a : 5 + a + b]
        self.ones, self.zeros = words[5 + a + b : 5 + a + b + c], words[5 + a + b + c :]
        self.mask = U64((1 << self.low) - 1)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Position of the k-th set (or unset) upper bit."""
        k = k.astype(U64)
        at = np.searchsorted(before, k, "right") - 1
        word = self.high[at]
        if flip:
            word = ~word
        left, place = (k - before[at]).astype(np.uint8), np.zeros(len(k), np.uint8)
        for width, mask in _SIX:
            below = np.bitwise_count(word & mask)
            up = left >= below
            left -= below * up
            step = up * np.uint8(width)
            word >>= step.astype(U64)
            place += step
        return at * 64 + place

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        at = i * self.low
        shift = (at & 63).astype(U64)
        first = self.packed[at >> 6] >> shift
        second = np.where(shift > 0, self.packed[(at >> 6) + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return ((first | second) & self.mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        if not len(i):
            return np.empty(0, np.int64)
        return ((self._select(i, self.ones, False) - i) << self.low) | self._lower(i)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First position in [begin, end) with at least ``value``, or ``end``; and whether it has just that."""
        top = value >> self.low
        inside = top < int(self.zeros[-1]) - 1
        safe = np.where(inside, top, 0)
        after = self._select(safe, self.zeros, True) - safe  # ones before the zero that closes this upper part
        first = np.zeros(len(value), np.int64)
        some = safe > 0
        first[some] = self._select(safe[some] - 1, self.zeros, True) - (safe[some] - 1)
        lo, hi = np.clip(first, begin, end), np.clip(after, begin, end)
        last = hi.copy()
        want = value & int(self.mask)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            small = self._lower(mid) < want[open_]
            lo[open_] = np.where(small, mid + 1, lo[open_])
            hi[open_] = np.where(small, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        # Up to ``last`` the upper part is that of the value.
        same = np.flatnonzero(inside & (lo < last))
        exact = np.zeros(len(value), bool)
        exact[same] = self._lower(lo[same]) == want[same]
        return np.where(inside, lo, end), exact
