"""64-bit hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MEMO = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> hash. Emptied when it holds too many words, which costs time only."""

    def __missing__(self, word):
        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 12)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]), dtype=np.uint64)
        return self.up, self.down


def windows(h: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, given the words' hashes."""
    k = len(h) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    if n == 1:
        return mix(h)
    up, down = powers.to(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((sums[n:] - sums[:k]) * down[:k] + np.uint64(n))


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of a hash by its high bits, so sorted hashes have ascending buckets."""
    return ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
