"""Decontamination against brute-force BM25 over all passages and items, and on planted items."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusfit.llm import decontam

WORDS = [a + b for a in "bcdfghjklm" for b in ("a", "er", "ist", "on", "und", "ave", "i", "opo", "uro", "ey")]


def text(rng, n):
    # A few words are very frequent.
    return [rng.choice(WORDS[:6]) if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def items():
    rng = random.Random(1)
    out = []
    for k in range(70):
        words = text(rng, rng.randrange(8, 150))
        words[len(words) // 2] += "."
        out.append((k, " ".join(words).capitalize() + "."))
    return [*out, (70, None), (71, ""), (72, "too short"), (73, out[0][1])]


@pytest.mark.parametrize("threshold,block", [(0.3, 4), (0.7, 8), (0.5, 1)])
def test_search_equals_scoring_everything(items, threshold, block):
    rule = decontam.Rule(threshold=threshold, block=block)
    index = decontam.build(items, rule)
    rng = random.Random(2)
    docs = [" ".join(text(rng, rng.randrange(0, 500))) for _ in range(60)]
    docs[3] += " " + items[4][1].upper() + " " + " ".join(text(rng, 50))
    words, edges = decontam.expand(pa.array(docs), decontam.TermIds(index))
    words = words.astype(np.int64)
    hits = 0
    for k, passages in enumerate(decontam.promising(index, words, edges)):
        own = words[edges[k]:edges[k + 1]]
        for stride in range(-(-len(own) // rule.stride)):
            query = np.unique(own[stride * rule.stride:][:3 * rule.stride])
            scores = np.zeros(len(index.part_item))
            for t in query[query > 0]:
                scores[index.parts[index.first[t]:index.first[t + 1]]] += index.weights[index.first[t]:index.first[t + 1]]
            want = {int(p): round(float(scores[p]), 9) for p in np.flatnonzero(scores >= threshold)}
            got = decontam.block_max_wand(index, query[query > 0], threshold)
            assert {p: round(s, 9) for p, s in got} == want
            assert not want or stride in passages
            hits += len(want)
    assert hits > 3


def test_planted_items(spark, items):
    rng = random.Random(3)
    docs, planted = [], set()
    for k in range(80):
        words = text(rng, rng.randrange(5, 400))
        if k % 4 == 0:
            item = items[k % 70]
            inside = item[1].split()
            if k % 8 == 0:
                inside = [w.upper() + "###" for w in inside]
            at = rng.randrange(len(words))
            words[at:at] = inside
            planted.add((k, item[0]))
        docs.append((k, " ".join(words), "x", 1))
    docs += [(900, None, "x", 1), (901, "", "x", 1), (None, items[5][1], "x", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contaminated(frame, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    copies = {(d, 73) for d, i in planted if i == 0} | {(None, 5)}
    assert got == planted | copies
    assert all(0.7 <= r.score <= 1 + 1e-9 for r in rows)
    small = decontam.contaminated(frame, bench, decontam.Rule(group_bytes=6000)).collect()
    assert {(r.doc_id, r.item_id) for r in small} == got
    kept = decontam.clean(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d[0] for d in docs[:-1] if d[0] not in {p for p, _ in planted})


def test_empty_sides(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 0
    assert decontam.contaminated(bench.withColumnRenamed("item_id", "doc_id"), bench.limit(0)).count() == 0
    assert decontam.contaminated(bench.withColumnRenamed("item_id", "doc_id"), bench).count() == 1


def edited(rng, words, share):
    return [f"zz{k}" if rng.random() < share else w for k, w in enumerate(words)]


@pytest.mark.parametrize("answer", [1, 2, 3, 4, 6])
def test_short_answers_with_labels_and_edits(answer):
    rng = random.Random(answer)
    rows, pairs = [], []
    for k in range(40):
        q, a = rng.sample(WORDS, rng.randrange(9, 25)), rng.sample(WORDS, answer)
        rows.append((k, " ".join(q) + "? " + " ".join(a)))
        pairs.append((q, a))
    rule = decontam.Rule()
    index = decontam.build(rows, rule)

    def found(words):
        docs = pa.array([" ".join([f"b{i}" for i in range(60)] + words + [f"e{i}" for i in range(60)])])
        got, edges = decontam.expand(docs, decontam.TermIds(index))
        got = got.astype(np.int64)
        return {index.items[i][0] for i in decontam.matches(index, got, decontam.promising(index, got, edges)[0])}

    lost = 0
    for k, (q, a) in enumerate(pairs):
        assert k in found(q + a)
        for label in (["Answer:"], ["The", "right", "answer", "is", "(B)"], ["Answer:", "\n"]):
            assert k in found(q + label + a)
        assert k in found(a + ["is", "what", "was", "asked:"] + q)
        at = rng.randrange(len(q))
        assert k in found(q[:at] + ["other"] + q[at + 1:] + a)
        assert k in found(q[:at] + ["more"] + q[at:] + a)
        if answer > 2:
            at = rng.randrange(answer)
            assert k in found(q + ["Answer:"] + a[:at] + ["other"] + a[at + 1:])
        lost += k not in found(edited(rng, q, 0.1) + a)
        assert k not in found(q[:len(q) // 3] + a)
        assert k not in found(q + ["Answer:"] + [f"no{i}" for i in range(answer + 60)])
    assert lost <= 4


def test_short_question_with_a_label():
    rule = decontam.Rule()
    index = decontam.build([(1, "Define slow growth. A change that takes very long in most cases")], rule)
    for doc, want in (("Define slow growth. Answer: a change that takes very long in most cases", {0}),
                      ("define quick growth: a change that takes very long in most cases", {0}),
                      ("a change that takes very long in most cases", set())):
        words, edges = decontam.expand(pa.array([doc]), decontam.TermIds(index))
        words = words.astype(np.int64)
        assert set(decontam.matches(index, words, decontam.promising(index, words, edges)[0])) == want, doc


def test_items_of_few_words(spark, items):
    rows = [(1, "Capital of France? Paris."), (2, "yes"), (3, "one two three four five six seven"), (4, "Capital of France? Paris."), (5, "?!"),
            (6, items[0][1])]
    docs = [
        (1, "so: capital of france - PARIS", {1, 4}), (2, "capital of France is Paris", set()), (3, "capital of France?", set()), (4, "Paris", set()),
        (5, "Yes. " + "x " * 500 + "one two three four five six seven eight", {2, 3}), (6, "one two three four five six", set()), (7, "seven", set()),
        (8, None, set()), (9, "", set()), (10, "yes " + items[0][1], {2, 6})]
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").coalesce(1)
    want = {(d, i) for d, _, found in docs for i in found}
    for some in (rows, rows[:5]):
        bench = spark.createDataFrame(some, "item_id long, text string")
        got = decontam.contaminated(frame, bench).collect()
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})
        assert {(r.doc_id, r.item_id) for r in got} == {x for x in want if x[1] in {i for i, _ in some}}
        assert all(r.score > 0.999 for r in got)
        assert {r.first_word for r in got if (r.doc_id, r.item_id) == (5, 3)} == {480}
        assert [r.doc_id for r in decontam.clean(frame, bench).collect()] == [d for d, _, found in docs if not found]
