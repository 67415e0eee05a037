"""Exact round trips of the token files."""

import random
import zlib

import numpy as np
import pytest

from corpusfit.llm import token_store, word_tokens


def whole(text):
    library = word_tokens.shared(word_tokens.vocabulary()).library
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_round_trip(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 3 - 100, " ".join(rng.choice(["alpha", "beta,", "gamma", "δ", "42"]) for _ in range(rng.randrange(0, 200)))) for i in range(300)]
    rows += [(5000, None), (5001, ""), (5002, "x " * 30_000), (5003, "same"), (5003, "same"), (5003, "other"), (None, "no id"), (2**40, "far")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, count string").repartition(5)
    folder = str(tmp_path / "store")
    manifest = token_store.write_store(docs, folder, settings=token_store.Settings(sample_documents=50, documents_per_file=60))
    assert manifest.count() >= 5
    got = sorted(token_store.read_store(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(
        ((i, whole(t)) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].tobytes())))
    assert len(got) == len(want)
    start = 0
    for r, (doc_id, ids) in zip(got, want):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    # One document through its file's index.
    files = [token_store.StoreFile(folder, r.path) for r in manifest.collect()]
    for doc_id, text in rows[:20]:
        found = []
        for f in files:
            try:
                found.append(f.ids(doc_id) if doc_id is not None else None)
            except KeyError:
                pass
        assert doc_id is None or doc_id == 5003 or (len(found) == 1 and (found[0] == whole(text)).all())
    with pytest.raises(KeyError):
        files[0].ids(-12345)


def test_wide_ids_and_empty(spark, tmp_path):
    ids = np.array([1, 70_000, 2], "<u4")
    assert (token_store.deserialized(token_store.serialized(ids)) == ids).all()
    empty = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_store(empty, str(tmp_path / "none"))
    assert token_store.read_store(spark, str(tmp_path / "none")).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    token_store.write_store(one, f"file://{tmp_path}/one")
    assert [(r.doc_id, r.n_tokens) for r in token_store.read_store(spark, f"file://{tmp_path}/one").collect()] == [(1, 2)]
