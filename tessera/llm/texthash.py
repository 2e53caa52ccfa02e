"""Vectorised hashing of words, word windows and byte windows in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd multiplier with its inverse modulo 2**64.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = (int(_rng.integers(1 << 60, 1 << 62)) * 8 + 3) % (1 << 64)
INVERSE = pow(BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((BASE, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words (runs of bytes other than ASCII white space) of each row begin and end; no word crosses rows."""
    inside = ~WHITE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[:-1][at[:-1] < at[1:]]
    first[edge] = inside[edge]
    edge = at[1:][at[:-1] < at[1:]] - 1
    last[edge] = inside[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of a sequence of 64-bit values."""
    up, down = _power(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=total[1:])
    if not len(begin):
        return np.zeros(0, np.uint64)
    out = (total[end] - total[begin]) * down[np.minimum(begin, len(down) - 1)]
    return mix(out ^ (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's windows of k words, A-Z lower-cased, and the row of each; a row of fewer words has one."""
    begin, end = words(raw, at)
    word = spans(BYTE[LOWER[raw]], begin, end)
    row_first = np.searchsorted(begin, at)
    n = np.diff(row_first)
    row = np.repeat(np.arange(len(n)), n)
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = row_first[row + 1] - np.arange(len(word))  # words from here to the row's end
    full = np.flatnonzero(left >= k)
    short = np.flatnonzero((n > 0) & (n < k))
    begins = np.concatenate([full, row_first[short]])
    ends = np.concatenate([full + k, row_first[short + 1]])
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], ends[order]
    return spans(word, begins, ends), row[begins]


def windows(raw: np.ndarray, k: int, lower: bool = False) -> np.ndarray:
    """The hash of each window of k bytes of one buffer."""
    if len(raw) < k:
        return np.zeros(0, np.uint64)
    part, size = BYTE[LOWER[raw] if lower else raw], 1
    out, done, bit = None, 0, 1
    while bit <= k:
        if k & bit:
            if out is None:
                out, done = part, bit
            else:
                n = len(raw) - done - bit + 1
                out, done = out[:n] * np.uint64(pow(BASE, bit, 1 << 64)) + part[done : done + n], done + bit
        if bit * 2 <= k:
            n = len(raw) - 2 * bit + 1
            part = part[:n] * np.uint64(pow(BASE, bit, 1 << 64)) + part[bit : bit + n]
        bit *= 2
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    if len(x) < w:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < w:
        x = np.minimum(x[: len(x) - (w - size)], x[w - size :])
    return x
