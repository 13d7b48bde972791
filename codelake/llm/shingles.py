"""Hashes of words and of runs of five words, for a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import only_memory

WORDS = 5
_MOST = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words(dict):
    """A word's 64-bit hash, kept once made; emptied by `word_hashes` when it grows too large."""

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent."""
    x = x + _STEP
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int) -> np.uint64:
    return mix(np.array([seed], np.uint64))[0]


def words_of(text: str | None) -> list[str]:
    """Lower-case words between white space."""
    return text.lower().split() if text else []


def word_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and how many each text has."""
    only_memory("hashes", _words.clear)
    if len(_words) > _MOST:
        _words.clear()
    counts = np.array([len(t) for t in texts], np.int64)
    parts = [np.fromiter(map(_words.__getitem__, t), np.uint64, len(t)) for t in texts]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), counts


def shingle_hashes(texts: list[list[str]], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of n words, in order, and how many each text has.

    A text of fewer words, but at least one, has one run: all of its words. Runs
    that recur in a text recur in the result.
    """
    h, counts = word_hashes(texts)
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.maximum(counts - n + 1, np.minimum(counts, 1))
    if not len(h):
        return h, runs
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    for j in range(n):
        total += padded[j : j + len(h)] * factors[j]
    ends = np.cumsum(counts)
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = h[ends[i] - counts[i] : ends[i]]
        total[ends[i] - counts[i]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    at = np.arange(len(h)) - np.repeat(ends - counts, counts)
    return mix(total[at < np.repeat(runs, counts)]), runs


def split_by(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []
