"""Vectorised hashing of words and word shingles straight from UTF-8 bytes."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bytes hashed at once; longer texts are hashed piece by piece, cut at a space.
PIECE = 1 << 20
_r = np.random.default_rng(20240229)
LETTER = _r.integers(1, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
FACTORS = _r.integers(1, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(BASE, -1, 2**64)
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 16), x, np.uint64)), dtype=np.uint64) for x in (BASE, inverse)]
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, and the offsets of the texts among the words."""
    hashes, first, at = [], [], 0
    rows = len(offsets) - 1
    counts = np.zeros(rows, np.int64)
    space = SPACES[data]
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and not (space[to] or space[to - 1]):
            ahead = np.flatnonzero(space[to : to + PIECE])
            to = to + int(ahead[0]) if len(ahead) else min(len(data), to + PIECE)
        held = ~space[at:to]
        edges = np.zeros(to - at + 1, bool)
        inner = offsets[(offsets > at) & (offsets < to)] - at
        edges[inner] = True  # a text's end ends a word
        before = np.append(False, held[:-1])
        after = np.append(held[1:], False)
        start = np.flatnonzero(held & (~before | edges[:-1]))
        end = np.flatnonzero(held & (~after | edges[1:])) + 1
        p, q = powers(to - at)
        total = np.append(np.uint64(0), np.cumsum(LETTER[data[at:to]] * p[: to - at]))
        hashes.append(mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64)))
        counts += np.bincount(np.searchsorted(offsets, start + at, side="right") - 1, minlength=rows)[:rows]
        at = to
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.append(0, np.cumsum(counts))


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of five words; all words of a text that has fewer; and the offsets of the texts."""
    n = np.diff(offsets)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    out_offsets = np.append(0, np.cumsum(count))
    start = np.repeat(offsets[:-1], count) + np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], count)
    size = np.minimum(np.repeat(n, count), SHINGLE)
    padded = np.append(hashes, np.zeros(SHINGLE, np.uint64))
    total = np.zeros(len(start), np.uint64)
    for k in range(SHINGLE):
        total += np.where(k < size, padded[start + k] * FACTORS[k], np.uint64(0))
    return mix(total + size.astype(np.uint64)), out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's sorted distinct values, their counts, and the new offsets."""
    parts, counts, sizes = [], [], []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        v, c = np.unique(values[a:b], return_counts=True)
        parts.append(v)
        counts.append(c)
        sizes.append(len(v))
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(parts or empty), np.concatenate(counts or [np.zeros(0, np.int64)]), np.append(0, np.cumsum(np.array(sizes, np.int64)))
