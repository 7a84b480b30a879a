"""Words, word shingles and their hashes, for the near-duplicate operators."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import cached

#: Words of which a worker keeps the hash.
KEPT_WORDS = 60_000
P, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


class Hashes(dict):
    """A word's 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = got
        return got


HASHES = Hashes()
cached("shingles", HASHES.clear)


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cases A-Z; words are what isn't blank, tab or a line or page break."""
    return raw.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S33)) * M2
    return x ^ (x >> S33)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; of fewer words than that, their whole sequence is one."""
    h = word_hashes(words_of(raw))
    if not len(h):
        return h
    n = min(width, len(h))
    acc = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        acc = acc * P + h[k : len(h) - n + 1 + k]
    if n < width:
        acc = acc + np.uint64(n)
    return np.unique(mixed(acc))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Values in both of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
