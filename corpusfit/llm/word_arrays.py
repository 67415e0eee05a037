"""Whole texts as arrays of 32-bit values that follow word by word, with each distinct word worked out once.

Arrow splits texts at ASCII white space and numbers the words; a memo of bounded size has the values of the words a worker
met before. Used where a value per word has to be looked up for very many words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTES = 4
BYTES_AT_ONCE = 4_000_000


_in_use: list = []


def take_over(memo) -> None:
    """Make ``memo`` the only one of this process that holds words: workers are reused from one operator to the next."""
    if not _in_use or _in_use[0] is not memo:
        for other in _in_use:
            other.forget()
        _in_use[:] = [memo]


class WordMemo(dict):
    """Buffers of little-endian unsigned 32-bit values by word, in two generations of bounded size."""

    def __init__(self, words_kept: int = 200_000):
        super().__init__()
        self.words_kept = words_kept
        self.old: dict[bytes, bytes] = {}

    def made(self, word: bytes) -> bytes:
        raise NotImplementedError

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, word: bytes) -> bytes:
        values = self.old.get(word)
        if values is None:
            values = self.made(word)
        if len(self) >= self.words_kept:
            self.old = dict(self)
            self.clear()
        self[word] = values
        return values


def in_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a bounded number of bytes (of one text at least), with null as empty text."""
    at, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right")))
        yield pc.fill_null(texts.slice(at, stop - at), "")
        at = stop


def expand(texts: pa.Array, memo: WordMemo) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words of the texts (A-Z lower-cased) one after another, and where each text begins and ends."""
    take_over(memo)
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    own = list(map(memo.__getitem__, coded.dictionary.cast(pa.binary()).to_pylist()))
    flat = np.frombuffer(b"".join(own), "<u4")
    sizes = np.fromiter(map(len, own), np.int64, len(own)) // BYTES
    starts = np.cumsum(sizes) - sizes
    order = coded.indices.to_numpy()
    counts = sizes[order]
    after = np.cumsum(counts)
    total = after[-1] if len(after) else 0
    values = flat[np.repeat(starts[order] - (after - counts), counts) + np.arange(total)]
    return values, np.concatenate([[0], after])[split.offsets.to_numpy() - split.offsets[0].as_py()]
