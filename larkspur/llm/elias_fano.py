"""Elias-Fano sequences: n sorted values below u in about 2 + log2(u / n) bits each, read in place by vectorised access and search."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: In a byte, the place of its k-th set bit (8 if it has fewer).
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)

def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of so many bits, one after the other, in words of 64 bits (with one more at the end)."""
    out = np.zeros(len(values) * width // 64 + 2, U)
    if width and len(values):
        bit = np.arange(len(values), dtype=np.int64) * width
        word, off = bit >> 6, (bit & 63).astype(U)
        np.bitwise_or.at(out, word, values << off)
        over = np.flatnonzero(off.astype(np.int64) + width > 64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (U(64) - off[over]))
    return out


def unpack(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), U)
    bit = at * width
    word, off = bit >> 6, (bit & 63).astype(U)
    low = words[word] >> off
    high = np.where(off > 0, words[word + 1] << ((U(64) - off) & U(63)), U(0))
    return (low | high) & U((1 << width) - 1)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """values: sorted, below universe. The arrays that make up the sequence."""
    n = len(values)
    width = max(0, (universe // max(n, 1)).bit_length() - 1)
    values = values.astype(U)
    high = (values >> U(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(((universe >> width) + n + 2 + 63) // 64 * 64, np.uint8)
    bits[high] = 1
    words = np.packbits(bits, bitorder="little").view(U)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
    zeros = np.arange(len(ones)) * 64 - ones
    return {"low": pack(values & U((1 << width) - 1), width), "high": words, "ones": ones, "zeros": zeros, "shape": np.array([n, width], np.int64)}


def _select(words: np.ndarray, ranks: np.ndarray, at: np.ndarray, flip: bool) -> np.ndarray:
    """The place of the at-th set bit (or unset one, with flip). ranks: how many there are before each word."""
    word = np.searchsorted(ranks, at, "right") - 1
    left = at - ranks[word]
    w = ~words[word] if flip else words[word]
    shift = np.zeros(len(at), U)
    for half in (U(32), U(16), U(8)):
        n = np.bitwise_count((w >> shift) & U((1 << int(half)) - 1)).astype(np.int64)
        on = left >= n
        left -= np.where(on, n, 0)
        shift += np.where(on, half, U(0))
    return (word << 6) + shift.astype(np.int64) + _SELECT[((w >> shift) & U(255)).astype(np.int64), left]


class EliasFano:
    """Reads the arrays of encode(), which may be memory-mapped."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.ones, self.zeros = arrays["low"], arrays["high"], arrays["ones"], arrays["zeros"]
        self.n, self.width = (int(x) for x in arrays["shape"])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Values at places."""
        at = np.asarray(at, np.int64)
        return ((_select(self.high, self.ones, at, False) - at).astype(U) << U(self.width)) | unpack(self.low, at, self.width)

    def _search(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Successors, where their buckets end, and the values' low bits.

        The value's high bits name a bucket of about one entry, found by the zeros around it; all of its entries share them, so only low bits are compared.
        """
        high = (values >> U(self.width)).astype(np.int64)
        low = values & U((1 << self.width) - 1)
        before = np.where(high > 0, _select(self.high, self.zeros, np.maximum(high - 1, 0), True) + 1, 0) - high
        lo = np.clip(before, first, last)
        end = np.clip(_select(self.high, self.zeros, high, True) - high, first, last)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            small = unpack(self.low, mid, self.width) < low[open_]
            lo[open_[small]] = mid[small] + 1
            hi[open_[~small]] = mid[~small]
            open_ = open_[lo[open_] < hi[open_]]
        return lo, end, low

    def successor(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each value (below the universe) the first place in [first, last) whose value is not smaller (last if there is none)."""
        return self._search(values, first, last)[0]

    def find(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the values there are in [first, last), and their successors' places."""
        at, end, low = self._search(values, first, last)
        inside = np.flatnonzero(at < end)
        return inside[unpack(self.low, at[inside], self.width) == low[inside]], at
