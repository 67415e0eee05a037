"""The chain on held-out documents, its parts against plain formulas, and its defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusfit.llm import toxicity

WORDS = [a + b for a in "kltmnrbdgp" for b in ("a", "en", "or", "ist", "u", "ap", "ie", "ond")]
BAD, SPAM = ["scumbag", "idiot", "moron", "verminous", "verminish"], ["casino", "pills", "winner"]


def corpus(seed, n):
    rng, docs, labels = random.Random(seed), [], []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 120))]
        spam, toxic = rng.random() < 0.3, rng.random() < 0.2
        for kind, said in ((SPAM, spam), (BAD, toxic)):
            for _ in range(rng.randrange(1, 4) if said else 0):
                words.insert(rng.randrange(len(words)), rng.choice(kind).capitalize() + rng.choice([".", "", "!!"]))
        docs.append((k, " ".join(words), "x"))
        labels.append((k, int(not spam), int(toxic), "y"))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus(1, 500)
    labels += [(9999, 1, 1, "no document"), (3, None, 1, "null"), (None, 1, 0, "no id")]
    frames = (
        spark.createDataFrame(docs, "doc_id long, text string, toxic string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    return toxicity.train(*frames, toxicity.categories_of_labels(), toxicity.Settings(features=60))


def test_held_out_accuracy(spark, trained):
    docs, labels = corpus(2, 400)
    rows = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string, toxic string"), trained).collect()}
    truth = {k: (not good, bool(bad)) for k, good, bad, _ in labels}
    assert np.mean([rows[k].toxic == t[1] for k, t in truth.items()]) > 0.97
    assert np.mean([rows[k].low_quality == t[0] for k, t in truth.items()]) > 0.97
    assert trained.categories == ("low_quality", "toxic") and all(h[0] > 0.95 for h in trained.held_out)
    # The second model has one weight more: the first category's probability.
    assert [len(w) for w in trained.weights] == [1 + len(trained.features), 2 + len(trained.features)]
    kept = toxicity.keep_clean(spark.createDataFrame(docs, "doc_id long, text string, toxic string"), trained, "toxic")
    assert kept.columns == ["doc_id", "text", "toxic"] and {r.doc_id for r in kept.collect()} == {k for k in truth if not rows[k].toxic}


def test_probabilities_by_formula(trained):
    texts = ["Idiot moron ka len", "", None, "CASINO pills!! " * 50]
    got = toxicity._scores(pa.array(texts), trained)
    for text, row in zip(texts, got):
        x = np.zeros(len(trained.features))
        for word in (text or "").split():
            for f in toxicity.features_of(word, trained.settings.prefixes):
                if f in trained.features:
                    x[trained.features[f]] += 1
        inputs = [1.0, *np.log1p(x)]
        for k, w in enumerate(trained.weights):
            p = 1 / (1 + np.exp(-np.clip(np.dot(inputs, w), -30, 30)))
            assert row[k] == pytest.approx(p, rel=1e-6)
            inputs.append(p)


def test_defined_cases(spark, trained):
    rows = [(1, None), (1, None), (2, ""), (None, "idiot moron scumbag idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(toxicity.score(docs, trained).collect()) == 4
    assert sorted(r.doc_id for r in toxicity.keep_clean(docs, trained, "toxic").collect()) == [1, 1, 2]
    assert toxicity.score(docs.limit(0), trained).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, toxicity.categories_of_labels())
    assert {(r.toxic, r.low_quality) for r in toxicity.score(docs, chain).collect()} <= {(True, True), (False, False)}


def test_newton_finds_the_optimum():
    rng = np.random.default_rng(3)
    x = np.hstack([np.ones((5000, 1)), rng.normal(size=(5000, 4))]).astype(np.float32)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(x @ np.array([-1, 2, 0, -1, 0.5]))))).astype(float)
    w = toxicity.fit_logistic(x, y, np.arange(5000), 1e-6, 30)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(x.T @ (p - y)).max() < 0.1 and np.abs(w - [-1, 2, 0, -1, 0.5]).max() < 0.2
