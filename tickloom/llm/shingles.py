"""Word shingles as sets of 64-bit hashes, and minwise sketches of them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Coordinates of a sketch.
COORDS = 256

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 2**32, COORDS, np.uint32)
_MUL = _rng.integers(0, 2**31, COORDS, np.uint32) * 2 + 1


class _Words(dict):
    """Hash of every word seen; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words (A-Z in lower case, cut at ASCII blanks).

    Fewer words give the whole sequence as one shingle, no words the empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mix(out + h[j: len(h) - n + 1 + j])
    return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Minimum of the set under every one of ``COORDS`` hash functions."""
    low = np.full(COORDS, 2**32 - 1, np.uint32)
    for a in range(0, len(shingles), 4096):
        y = ((shingles[a: a + 4096] >> np.uint64(32)).astype(np.uint32)[:, None] ^ _XOR) * _MUL
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        low = np.minimum(low, y.min(0))
    return low


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, exactly; empty sets are like nothing."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
