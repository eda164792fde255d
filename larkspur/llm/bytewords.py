"""Vectorised word hashing on Arrow string buffers: no Python object per word.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A word's hash is a polynomial over its bytes modulo 2^64, mixed with its
length, computed for all words of a slice at once from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes whose prefix sums are held at once.
SLICE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE, n)
    if size not in _powers:
        _powers.clear()
        p, q = np.full(size, _BASE, U), np.full(size, _INVERSE, U)
        p[0] = q[0] = U(1)
        _powers[size] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers[size]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each starts (one more than texts); null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = 2 * SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many bytes (or one longer text)."""
    sizes = np.diff(_buffers(texts)[1])
    first, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield first, k
            first, total = k, 0
        total += n
    if len(texts) > first:
        yield first, len(texts)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and where each text's words start (one more than texts)."""
    data, at = _buffers(texts)
    if not len(data):
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    out = np.empty(len(starts), U)
    k = 0
    while k < len(starts):
        a = starts[k]
        m = max(k + 1, int(np.searchsorted(ends, a + SLICE, "right")))
        part = data[a : ends[m - 1]]
        p, q = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum((_LOWER[part] if lower else part).astype(U) * p[: len(part)] + p[: len(part)], out=sums[1:])
        s, e = starts[k:m] - a, ends[k:m] - a
        out[k:m] = mix((sums[e] - sums[s]) * q[s] ^ (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        k = m
    return out, np.searchsorted(starts, at, "left")


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; a text of fewer words has its whole sequence as one, an empty one none."""
    h, at = word_hashes(texts)
    c = [mix(np.array([i + 1], U))[0] | U(1) for i in range(n)]
    grams = np.zeros(max(len(h) - n + 1, 0), U)
    for i in range(n):
        grams += h[i : i + len(grams)] * c[i]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix((h[a:b] * np.array(c[: b - a], U)).sum(dtype=U, keepdims=True) ^ U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
