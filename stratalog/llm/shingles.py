"""Hashed word shingles of texts, shared by the near-duplicate operator and the classifier."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

from stratalog.llm.common import LOWER_BYTES
from stratalog.llm.fuse import mix

CACHE_WORDS = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio


class WordHashes(dict):
    """64-bit hashes by word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


known_words = WordHashes()


def lower_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at space and the controls from tab to carriage return."""
    return (text or "").encode().translate(LOWER_BYTES).split()


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(known_words.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; none when there are fewer words.

    A run is a sum of its word hashes, each times an odd constant of its place, mixed.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = mix(np.arange(seed, seed + size, dtype=np.uint64) * _ODD) | np.uint64(1)
    out = hashes[:n] * factors[0]
    for k in range(1, size):
        out += hashes[k:k + n] * factors[k]
    return mix(out)


def shingle_set(words: Sequence[bytes], size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``size`` are one shingle, none is none."""
    hashes = word_hashes(words)
    return np.unique(rolled(hashes, min(size, len(hashes)) or 1))


class Minima:
    """Minima of ``count`` universal hash functions x -> (a x + b) mod 2^32 over a set.

    x is the upper half of a well-mixed 64-bit hash; 32-bit products go through SIMD units.
    """

    def __init__(self, count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, count) * 2 + 1).astype(np.uint32)
        self.b = rng.integers(0, 2**32, count).astype(np.uint32)

    def __call__(self, values: np.ndarray, block: int = 1024) -> np.ndarray:
        out = np.full(len(self.a), 2**32 - 1, np.uint32)
        x = (values >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), block):
            part = x[None, at:at + block] * self.a[:, None] + self.b[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out
