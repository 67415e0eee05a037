"""Token ids of whole texts, with each distinct word encoded once per Python worker.

The word-level vocabulary drops white space and lower-cases, so the ids of a text are the ids of its
white-space separated words one after another. Texts that hold the opening of a special token go to the library whole.
"""

from __future__ import annotations

import functools
import os
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusfit.llm.word_arrays import WordMemo, expand, in_parts

ID_BYTES = 4
LATIN_END = "ɐ"
MARKS = "!\"#$%&()*+,-./:;=?@[]^_`{}~"

assert sys.byteorder == "little" and array("I").itemsize == ID_BYTES


def vocabulary() -> str:
    """File of the production vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(WordMemo):
    """Ids of single words."""

    def __init__(self, model, whole, words_kept: int):
        super().__init__(words_kept)
        self.model, self.whole = model, whole
        # Byte alphabet of the vocabulary: printable bytes stand for themselves, others follow from U+0100.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def made(self, word: bytes) -> bytes:
        text = word.decode()
        stem = text.rstrip(MARKS)
        if stem and stem is not text and stem[-1] < LATIN_END and stem[-1].isalpha():
            # Marks at the end of a word always make a piece of their own after a letter.
            return self[stem.encode()] + self[text[len(stem):].encode()]
        if not text.isalpha():
            return self.whole(text)
        if not text.isascii():
            small = text.lower()
            if max(text) >= LATIN_END or len(small) != len(text) or not unicodedata.is_normalized("NFC", text):
                return self.whole(text)
            text = "".join(map(self.letters.__getitem__, small.encode()))
        # One run of lower-case letters is one piece: only the merges are left to do.
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()


class WordTokens:
    """Encoder for arrays of texts."""

    def __init__(self, path: str, words_kept: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = WordIds(self.library.model, self._whole, words_kept)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text in order (unsigned 32-bit); null counts as empty."""
        for part in in_parts(texts):
            special = pc.match_substring(part, "<|")
            values, edges = expand(pc.if_else(special, "", part), self.words)
            for k, whole in enumerate(special.to_pylist()):
                yield np.frombuffer(self._whole(part[k].as_py()), "<u4") if whole else values[edges[k]:edges[k + 1]]


@functools.cache
def shared(path: str) -> WordTokens:
    """The encoder of this worker process."""
    return WordTokens(path)
