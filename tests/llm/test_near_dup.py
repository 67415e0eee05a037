"""Near-duplicates against all pairs of full sets."""

import random

import pytest

from corpusfit.llm import components, near_dup

WORDS = [a + b for a in "kltmnr" for b in ("a", "en", "or", "ist", "u", "ap")]


def brute(rows, words):
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
        sets[doc_id] = s
    ids = sorted(sets)
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, s = sorted((root(i), root(j)))
                low[s] = r
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, family, edits):
    rng = random.Random(seed)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    rows, base = [], text(120)
    for _ in range(family):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        rows.append(" ".join(own))
    for _ in range(25):
        own = text(rng.randrange(1, 60))
        rows += [" ".join(own), " ".join(own).upper(), " ".join(own + text(1)), "  ".join(own)]
    rows += ["", None, " \t\n", "one", "ONE", "one\x0btwo", "One two", "Été été", "été été"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words,crowd", [(2, 1024), (2, 0), (5, 8)])
def test_components_equal_all_pairs(spark, words, crowd):
    rows = corpus(words + crowd, 70, 22)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int").repartition(5, "doc_id")
    rule = near_dup.Rule(words=words, pairs_as_rows=crowd, block_members=9, block_shingles=500)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, rule).collect()}
    assert got == brute(rows, words)


def test_rows_without_id_and_repeats(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [
        (-1, None, True), (3, 3, True), (3, 3, True), (9, 3, False)]
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    bounds = near_dup.least_matches(near_dup.Rule())
    assert [n for n, _ in bounds] == list(range(16, 129, 16)) and all(m < 0.8 * n for n, m in bounds)


def test_components_of_a_chain_and_a_star(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 200)] + [(7, 7)]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 200)}
