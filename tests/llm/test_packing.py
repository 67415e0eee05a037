"""Packing against the library's own ids and against its limits."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusfit.llm import packing, word_tokens

ROWS = [
    (0, "To thbleor theati, hein! to ertionnt of antion thinhe's", "x"), (1, None, "x"), (2, "", "y"), (3, "a" * 9000, "y"),
    (4, "Était-ce l'été ß İstanbul é ñandú 12.5 <|endoftext|> <|ENDOFTEXT|>", "z"), (5, " \x0b\x1c 　 ", "z"),
    (6, "word. " * 5000, "z"), (6, "word. " * 5000, "z"), (None, "no id", None),
]


def whole(texts):
    library = word_tokens.shared(word_tokens.vocabulary()).library
    return [np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(256, 3, 200), packing.Limits(64, 2, 7)])
def test_every_id_once_within_limits(spark, limits):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, length string").repartition(3, "doc_id")
    got = packing.pack(docs, limits=limits).collect()
    ids = dict(zip([r[0] for r in ROWS], whole([r[1] for r in ROWS])))
    seen = {}
    for r in got:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert len(piece) == r.length > 0 and zlib.crc32(piece.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc_id, parts in seen.items():
        copies = sum(1 for row in ROWS if row[0] == doc_id)
        marks = np.zeros(len(ids[doc_id]), int)
        for start, length in parts:
            marks[start:start + length] += 1
        assert (marks == copies).all()
    assert set(seen) == set(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own])
        assert [r.offset for r in own] == [0, *ends[:-1]]
        total = int(ends[-1])
        assert total <= limits.tokens and len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss
        assert total == limits.tokens or total & (total - 1) == 0


def test_prompt_ids_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "one two three four", 3)], "doc_id long, text string, prompt long")
    assert [r.loss_tokens for r in packing.pack(docs, quiet="prompt").collect()] == [1, 1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).count() == 0


def test_words_one_by_one_equal_whole_texts():
    texts = [r[1] for r in ROWS] + ["don't 'tis we'll.,a., B.C. x,y, ... é$$$ ÉTÉ!? 's. 1,", "ﬁ Ǆ ſ K", "ABC,\tdéjà,vu.\r\n", " a", "\n"]
    encoder = word_tokens.WordTokens(word_tokens.vocabulary(), 3)
    for array in (pa.array(texts), pa.array(["x", *texts])[1:], pa.array(texts[:1] * 3)[:0]):
        got = [x.tobytes() for x in encoder.encode(array)]
        assert got == [x[:-1].tobytes() for x in whole(array.to_pylist())]
