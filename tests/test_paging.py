"""Deep pages against a plain sort."""

import random

import pytest

from corpusfit.operators import topk


@pytest.mark.parametrize("direction", ["desc", "asc"])
def test_sought_pages_equal_sorted_pages(spark, direction):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 50.0, 50.0, 50.0, 100.0, rng.random() * 100])) for k in range(3000)]
    df = spark.createDataFrame(rows, "evaluation_id long, total_score double").repartition(4)
    sign = -1 if direction == "desc" else 1
    order = sorted(rows, key=lambda r: (sign * (float("-inf") if r[1] is None else r[1]), r[0]))
    for page in (1, 20, 75, 149, 150, 151, 400):
        got = [r.evaluation_id for r in topk.sort_page(df, "total_score", direction, page, 20, most=100).collect()]
        assert got == [k for k, _ in order[(page - 1) * 20:page * 20]], page


def test_all_rows_of_one_value(spark):
    df = spark.range(2000).selectExpr("id AS evaluation_id", "cast(7 as double) AS total_score")
    assert [r.evaluation_id for r in topk.sort_page(df, page=90, limit=20, most=50).collect()] == list(range(1780, 1800))
    assert topk.sort_page(df.limit(0), page=90, limit=20, most=50).count() == 0


def test_terms_of_a_text_share_its_sentences(spark):
    docs = spark.createDataFrame([(1, "We built it with Spark in Berlin. Short. Machine work is what we learn here!"), (2, None)], "doc_id long, text string")
    hits = spark.createDataFrame([(1, "spark"), (1, "machine learning"), (1, "spark"), (2, "x"), (3, "y")], "doc_id long, term string")
    got = {(r.doc_id, r.term): r.excerpt for r in topk.best_excerpts(docs, hits).collect()}
    assert got == {(1, "spark"): "We built it with Spark in Berlin", (1, "machine learning"): "Machine work is what we learn here", (2, "x"): None}
