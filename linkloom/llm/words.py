"""Words of UTF-8 texts as 64-bit hashes, computed for whole Arrow batches in numpy.

A word's hash is a polynomial over its lower-cased bytes modulo 2^64, taken from prefix sums and
finished by a bit mixer. Two of a billion different words collide with a chance of about 3 %.

Prefix sums are taken over blocks of whole words, so what a worker needs beside the texts does not grow
with the batch; a word's hash does not depend on its place in a block.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []
#: Bytes whose prefix sums are held at once; a longer word is a block by itself.
_BLOCK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of bytes that are not white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        m = max(_BLOCK + 1, 1 << n.bit_length())
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits; the argument is overwritten."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; words never cross rows."""
    inside = is_word[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE):
    """Hash of each word, and each row's offsets in them; also the words' bounds in bytes."""
    data = LOWER[data]
    starts, ends = bounds(data, offsets, is_word)
    h, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + _BLOCK, "right")))
        a, b, n = starts[at:to] - first, ends[at:to] - first, int(ends[to - 1] - first)
        up, down = _tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[first : first + n]] * up[:n], out=sums[1:])
        h[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h), np.searchsorted(starts, offsets), starts, ends


def grams(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words inside a row, and the run's row."""
    n = np.maximum(np.diff(offsets) - (k - 1), 0)
    rows = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    return run_hashes(h, first, k), rows


def run_hashes(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each of the positions ``first``."""
    out = np.full(len(first), k, np.uint64)
    for i in range(k):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += h[first + i]
    return mix(out)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position of one sequence, by prefix sums (any k at equal cost)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = _tables(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1])
