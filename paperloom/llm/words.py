"""Words of a text as 64-bit hashes, in numpy.

A word is ``[^\\x20\\x09-\\x0D]+``.  ``bytes.split`` cuts at exactly these characters and
``bytes.lower`` changes A-Z only, and UTF-8 never uses such bytes inside a character.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered per Python worker; beyond that the memory is emptied and filled anew.
REMEMBERED = 300_000

_MULTIPLIERS = np.random.Generator(np.random.Philox(20240117)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word -> 64-bit hash, computed once per distinct word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of a counter-based generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x ^= x >> np.uint64(27)
    x = x * _B
    x ^= x >> np.uint64(31)
    return x


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, offsets) -> np.ndarray:
    """One hash per window start of the words at `offsets` (ascending, from 0)."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        total += hashes[o : o + n] * _MULTIPLIERS[k]
    return mix(total)


def shingle_set(text: str | None, k: int, lower: bool = True) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; a shorter text is one shingle, an empty one none."""
    words = split_words(text, lower)
    if not words:
        return np.empty(0, np.uint64)
    hashes = hash_words(words)
    if len(words) < k:
        return mix(np.array([np.sum(hashes * _MULTIPLIERS[: len(words)]) + np.uint64(len(words))], np.uint64))
    return np.unique(windows(hashes, range(k)))
