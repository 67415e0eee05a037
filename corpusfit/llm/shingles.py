"""Word shingles of whole texts as sorted 64-bit hashes, and MinHash signatures of such sets."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

from corpusfit.llm.word_arrays import take_over

#: A-Z are lower-cased and words are split at ASCII white space: what bytes.lower() and bytes.split() do.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
ROWS_AT_ONCE = 512


class WordHashes(dict):
    """64-bit hash of each word met, forgotten as a whole when there are too many."""

    def __init__(self, words_kept: int = 200_000):
        super().__init__()
        self.words_kept = words_kept

    def forget(self) -> None:
        self.clear()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.words_kept:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@functools.cache
def word_hashes() -> WordHashes:
    return WordHashes()


def hashes_of(text: bytes | None) -> np.ndarray:
    """Hash of every word of a text, in order."""
    words, memo = (text or b"").lower().split(), word_hashes()
    take_over(memo)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order; of the whole sequence when there are fewer words."""
    count = max(1, len(words) - size + 1) if len(words) else 0
    size = min(size, len(words))
    value = np.zeros(count, np.uint64)
    for k in range(size):
        value = mixed(value + words[k:k + count]) * MULTIPLIER
    return value


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Distinct runs, sorted; empty for a text without words."""
    return np.unique(runs(hashes_of(text), size))


@functools.cache
def multipliers(count: int) -> np.ndarray:
    """Odd factors, one for each hash function of a signature."""
    return (np.random.default_rng(20_240_601).integers(0, 1 << 31, count).astype(np.uint32) << np.uint32(1)) | np.uint32(1)


def signature(shingles: np.ndarray, count: int) -> np.ndarray:
    """The upper 16 bits of the least value under each of ``count`` hash functions."""
    low = np.full(count, 0xFFFFFFFF, np.uint32)
    narrow = (shingles >> np.uint64(32)).astype(np.uint32)
    factors = multipliers(count)
    for at in range(0, len(narrow), ROWS_AT_ONCE):
        np.minimum(low, (narrow[at:at + ROWS_AT_ONCE, None] * factors).min(axis=0), out=low)
    return (low >> np.uint32(16)).astype(np.uint16)
