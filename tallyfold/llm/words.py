"""Words and five-word shingles of a text, as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SHINGLE = 5
_find = re.compile(r"\w+").findall
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    return _find(text.lower()) if text else []


class WordHashes(dict):
    """Hashes of words, remembered; emptied when full."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def hash_list(w: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))


def word_hashes(text: str | None) -> np.ndarray:
    return hash_list(words(text))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of n words; of fewer than n words (but one at least) the one run that they are."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(31) + h[i : len(h) - n + 1 + i] + GOLDEN)
    return out


def multiset(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each occurs."""
    return np.unique(shingle_hashes(word_hashes(text)), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)
