"""Hashes of word shingles, computed for all positions of a text at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: Words of a shingle, and the similarity from which texts count as alike.
WORDS, SIMILARITY = 5, 0.8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words, remembered for one task; emptied when full."""

    def __init__(self, size: int = 200_000):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.size:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return WordHashes().of(words)


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """A hash for each run of ``size`` word hashes; for fewer words one of all of them; none for none."""
    size = min(size, len(words))
    if not size:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = h * _MULTIPLIER + words[k : k + n]
    return mix(h)


@lru_cache(maxsize=8)
def _table(values: bytes) -> tuple[np.ndarray, np.ndarray]:
    known = np.frombuffer(values, np.uint64)
    seen = np.zeros(1 << 20, bool)
    seen[(known >> np.uint64(44)).astype(np.int64)] = True
    return known, seen


def positions_of(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in h, positions in the sorted ``known``) of the hashes that are known."""
    if not len(known) or not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    known, seen = _table(known.tobytes())
    maybe = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
    hit = known[at] == h[maybe]
    return maybe[hit], at[hit]


def normal_words(data: bytes) -> list[bytes]:
    """Words of a text in UTF-8: A-Z in lower case, cut at white space, without the marks around them.

    A word of marks alone is left out, so that quoting, bullets or line ends do not hide a passage.
    """
    return [w for w in (x.strip(MARKS) for x in data.lower().split()) if w]


MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
