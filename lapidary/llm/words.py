"""Words and word shingles of a text, as Python functions for Arrow batches.

Words: after lower-casing, each Han character (U+4E00 to U+9FFF) is a word, and so is each longest run of other
letters or digits (Unicode L or N). A null text has no words.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile("[一-鿿]|[^\\W_一-鿿]+")
# ASCII needs no pattern: everything but letters and digits becomes a blank.
_ASCII = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))
_SEEN: dict[str, int] = {}
_SEEN_MAX = 200_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    return _WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hash(word: str) -> int:
    h = _SEEN.get(word)
    if h is None:
        if len(_SEEN) > _SEEN_MAX:
            _SEEN.clear()
        h = _SEEN[word] = xxhash.xxh64_intdigest(word)
    return h


def shingle_hashes(numbers: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mix(h * _M1 + numbers[j : j + n] * _M2 + _M3)
    return h


def shingles(text: str | None, k: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``k`` consecutive words; empty for shorter texts."""
    return np.unique(shingle_hashes(np.array([word_hash(w) for w in words(text)], np.uint64), k))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted distinct arrays; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
