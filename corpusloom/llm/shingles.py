"""Vectorised words and shingles of many texts at once, for use inside tasks.

Words are runs of bytes outside blank, tab, line feed, vertical tab, form feed and carriage return. A word's hash is
a polynomial over a random byte table modulo 2^64, mixed; it is the same in every process.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTE = np.random.default_rng(20_240_517).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = powers(BASE, 1 << 20), powers(BASE_INVERSE, 1 << 20)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = powers(BASE, n), powers(BASE_INVERSE, n)
    return _UP, _DOWN


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds): text i has the words bounds[i]:bounds[i+1]."""
    joined = b"\n".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    space = SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _tables(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[: len(data)], dtype=np.uint64)])
    hashes = mixed((total[ends] - total[starts]) * down[starts])
    text_starts = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    return hashes, np.searchsorted(starts, text_starts)


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, bounds); repeats within a text stay.

    A text with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    word, bound = words(texts)
    n = np.diff(bound)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_bound = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(bound[:-1] - out_bound[:-1], count) + np.arange(out_bound[-1])
    length = np.repeat(np.minimum(n, width), count)
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    out = mixed(length.astype(np.uint64))
    for k in range(width):
        out = np.where(length > k, (out ^ padded[first + k]) * U(0xD6E8FEB86659FD93) + U(k + 1), out)
        out ^= out >> U(32)
    return mixed(out), out_bound


def grouped(texts: list[bytes], limit: int = 1 << 20):
    """(from, to) ranges of consecutive texts of about ``limit`` bytes together, to bound the arrays."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
