"""Vectorised words and hashes over the bytes of many texts at once.

Words are the runs between the bytes 0x20 and 0x09-0x0D. The hash of a word is a
polynomial over its bytes modulo 2^64, read off prefix sums, and then mixed; two
independent hashes give 128 bits."""

from __future__ import annotations

import functools

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(4)
def _table(seed: int) -> tuple[int, np.ndarray]:
    r = np.random.default_rng(seed)
    base = int(r.integers(1 << 62, 1 << 63)) | 5
    return base, r.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _table(seed)[0]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0], done = 1, 1
            while done < size:
                step = min(done, size - done)
                p[done:done + step] = p[:step] * np.uint64(pow(b, done, 1 << 64))
                done += step
            out.append(p)
        have = _POWERS[seed] = (out[0], out[1])
    return have


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words of all texts, and for each text the
    number of its first word (one entry more than texts)."""
    n = len(data)
    word = np.empty(n + 2, bool)
    word[0] = word[n + 1] = False
    np.logical_not(SPACE[data], out=word[1:n + 1])
    begin = word[1:n + 1] & ~word[:n]
    end = word[1:n + 1] & ~word[2:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = word[1:][inner]
    end[inner - 1] = word[inner]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    up, down = _powers(seed, len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_table(seed)[1][data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring words (runs over text ends included)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _table(seed)[0]
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j:j + n] * np.uint64(pow(base, j + 1, 1 << 64))
    return mix(h)
