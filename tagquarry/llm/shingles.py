"""Sets of hashed word shingles, computed for record batches of texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
# Whitespace bytes, lower-casing of A-Z, and odd constants of the hashes.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: list = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_BASE))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, up to n."""
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(size, b, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts lying one after another in `data`, and each text's first word.

    The hash of a word is a polynomial over its bytes, taken as a difference of prefix sums.
    """
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    offsets = offsets - base
    n = len(data)
    space = _SPACE[data]
    before = np.ones(n + 1, bool)
    before[1:] = space
    before[offsets] = True  # a text's start ends the word before it
    starts = np.flatnonzero(before[:-1] & ~space)
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    after[inner - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    power, inverse = _power(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTES[_LOWER[data]] * power[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    return words, np.searchsorted(starts, offsets)


_STEP = [U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5):
    """The sorted distinct shingle hashes of each text; a text of fewer than k words has one."""
    words, first = word_hashes(data, offsets)
    rolled = np.zeros(max(0, len(words) - k + 1), U)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * (_STEP[j % 5] + U(2 * (j // 5)))
    rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            w = words[a:b]
            yield mix((w * np.array(_STEP[: b - a], U)).sum(keepdims=True, dtype=U) + U(b - a))
        else:
            yield np.zeros(0, U)


def batch_sets(column, k: int = 5, max_bytes: int = 500_000):
    """The shingle sets of an Arrow string column, in order; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    column = pa.concat_arrays([column]) if column.offset else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield from shingle_sets(data, offsets[i : j + 1], k)
        i = j
