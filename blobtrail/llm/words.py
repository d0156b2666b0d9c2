"""Words of a text as 64-bit hashes, shared by the operators on word n-grams."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    """Hash of each word; bounded, per worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


HASHES = WordHashes()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(33))) * MIX_1
    x = (x ^ (x >> np.uint64(33))) * MIX_2
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; empty with fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= ODD
        out += h[i : i + n]
    return mixed(out)
