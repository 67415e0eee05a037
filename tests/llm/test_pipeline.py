"""The stages in order, against what each stage's operator is tested to do, on a small planted corpus."""

import random

import pytest

import corpus_pipeline
from corpusfit.llm import near_dup, packing

WORDS = [a + b for a in "kltmnrbdgp" for b in ("a", "en", "or", "ist", "u", "ap", "ie")]
BAD = ["scumbag", "idiot", "moron", "vermin"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs, labels = [], []
    for k in range(160):
        words = text(60)
        toxic = k % 5 == 0
        if toxic:
            words += " " + " ".join(rng.choice(BAD) for _ in range(5)) + " " + text(20)
        docs.append((k, words, "en", f"s{k % 3}", len(words)))
        if k < 120:
            labels.append((k, int(k % 7 > 0), int(toxic)))
    item = text(30) + ". " + text(10) + "."
    docs += [
        (200, docs[1][1], "en", "s", 1), (201, docs[2][1] + " " + text(1), "en", "s", 1), (202, text(20) + " " + item, "en", "s", 1),
        (203, "Mail un.12@mail.example.com and 4111111111111111. " + text(30), "en", "s", 1), (204, None, "en", None, None), (205, "", None, "s", 0)]
    at = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = {*range(160), *range(200, 206)}
    clean = every - set(range(0, 160, 5))
    assert kept[0] == clean
    assert kept[1] == clean - {200, 201}
    assert kept[2] == clean - {200, 201, 202}
    assert kept[3] == kept[4] == kept[2]
    text = spark.read.parquet(str(tmp_path / "pii")).where("doc_id = 203").first().text
    assert "un.12@" not in text and "4111111111111111" not in text and "@mail.example.com" in text
    final = corpus_pipeline.run(spark, folder)
    assert final.columns == packing.NAMES
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, docs.collect()))


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_near_dedup_of_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f")], "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in near_dup.keep_first(docs).collect()) == [-1, 1]
