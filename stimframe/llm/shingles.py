"""Word shingles as sorted sets of 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one for each place in a shingle, from the fractional bits of square roots.
_PLACES = np.array([(int((p**0.5 % 1) * 2**63) << 1) | 1 for p in (2, 3, 5, 7, 11, 13, 17, 19)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_32 = np.uint64(32)


class WordHashes(dict):
    """64-bit hash of each word, kept for as many words as `bound`; those of more bytes than `longest` are hashed each time.

    So a worker's memory has a bound also where texts have no spaces, and each is one word.
    """

    def __init__(self, bound: int = 200_000, longest: int = 64):
        super().__init__()
        self.bound, self.longest = bound, longest

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Distinct n-word shingles of the whole text, A-Z lower-cased; the whole sequence as one if it has fewer words."""
    words = (text or b"").lower().split()  # of bytes: these touch A-Z and split at \x20 and \x09-\x0D alone
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    size = min(n, len(words))
    s = h[: len(h) - size + 1] * _PLACES[0]
    for k in range(1, size):
        s += h[k : len(h) - size + 1 + k] * _PLACES[k]
    s ^= s >> _32
    s *= _MIX
    s ^= s >> _32
    return np.unique(s)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))
