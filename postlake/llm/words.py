"""Words and their hashes, as the operators in Python workers share them.

A word is a run of bytes other than space and the control characters 9 to 13, after A-Z became a-z.
``bytes.lower`` and ``bytes.split`` do exactly that on UTF-8.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count, islice

import numpy as np
import xxhash

SHINGLE = 5
_STEP = np.array([(k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(64)], dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordCache(dict):
    """Maps a word to a value computed once; emptied at ``limit`` entries, so that memory stays bounded."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


class WordTable(defaultdict):
    """Numbers words, and keeps what ``make`` gives for them in arrays; emptied beyond ``limit`` words.

    A text then costs one look-up per word, arrays are read by number, and ``make`` gets all new words of a text at once:
    it returns an array per column.
    """

    def __init__(self, make, dtypes: tuple, limit: int = 200_000):
        super().__init__(count().__next__)
        self.make, self.limit = make, limit
        self.columns = [np.zeros(limit, dtype=d) for d in dtypes]

    def rows(self, tokens: list) -> list[np.ndarray]:
        """The columns' values for each token."""
        if len(self) > self.limit:
            self.clear()
            self.default_factory = count().__next__
        start = len(self)
        k = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if start < (end := len(self)):
            fresh = list(islice(reversed(self), end - start))[::-1]
            if end > len(self.columns[0]):
                self.columns = [np.concatenate([c, np.zeros(end, dtype=c.dtype)]) for c in self.columns]
            for column, values in zip(self.columns, self.make(fresh)):
                column[start:end] = np.array(values, dtype=column.dtype)
        return [c[k] for c in self.columns]


def each(make):
    """A function of one word as one of many, for ``WordTable``."""
    return lambda found: zip(*map(make, found))


def hash_cache() -> WordCache:
    return WordCache(xxhash.xxh64_intdigest)


def hashes(tokens: list[bytes], cache: WordCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, in order."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += mix(h[k : k + n] + _STEP[k])  # the position changes what a word adds
    return mix(total)


def shingle_set(text: str | None, cache: WordCache) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle, none without words."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    if len(tokens) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed=len(tokens))], dtype=np.uint64)
    return np.unique(windows(hashes(tokens, cache), SHINGLE))


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
