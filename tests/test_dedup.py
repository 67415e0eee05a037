"""Fingerprints and near-duplicate links against brute force, including hot buckets and copies."""

import hashlib
import random
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusfit.plans import dedup


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def bits(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


def brute_links(rows, limit):
    """(a, b, bits): between smallest ids of distinct prints, and smallest id to each copy."""
    first = {}
    for i, fp in sorted(rows):
        first.setdefault(fp, i)
    out = {(first[fp], i, 0) for i, fp in rows if first[fp] != i}
    for (f, i), (g, j) in combinations(first.items(), 2):
        if bits(f, g) <= limit:
            out.add((min(i, j), max(i, j), bits(f, g)))
    return out


def links(df, *cols):
    return {tuple(r) for r in df.select(*(cols or ("a", "b", "bits"))).collect()}


def neighbours(seed, n, spread):
    rng = random.Random(seed)
    rows, base = [], rng.getrandbits(64)
    for i in range(n):
        fp = base if i % 3 == 0 else rng.getrandbits(64)
        for _ in range(rng.randrange(spread)):
            fp ^= 1 << rng.randrange(64)
        rows.append((i, signed(fp)))
    return rows


def test_fingerprint_matches_definition(spark):
    text = "Hello, World hello"
    body = "helloworldhello"
    votes = [0] * 64
    for i in range(len(body) - 3):
        h = int.from_bytes(hashlib.md5(body[i:i + 4].encode()).digest()[-8:], "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    want = signed(sum(1 << b for b in range(64) if votes[b] > 0))
    got = dedup.simhash(spark.createDataFrame([(1, text), (2, ""), (3, "ab")], "doc_id long, text string"))
    prints = {r.doc_id: r.fp for r in got.collect()}
    assert prints[1] == want and set(prints) == {1, 2, 3}


def test_same_close_and_unrelated_texts(spark):
    base = "Senior engineer with ten years of Spark and Scala in retail and banking projects " * 6
    rows = [(1, base), (2, base), (3, base.replace("banking", "banqing", 1)), (4, "A cook in a small inn by the sea " * 12)]
    fp = {r.doc_id: r.fp for r in dedup.simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert fp[1] == fp[2] and bits(fp[1], fp[3]) <= 5 and bits(fp[1], fp[4]) > 10


def test_pairs_equal_brute_force(spark):
    rows = neighbours(7, 240, 6)
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    assert links(dedup.near_dup_pairs(fps)) == brute_links(rows, 3)


def family(n, flips, seed=5):
    """Edited copies of one print: all different, each a few bits from it."""
    rng, base = random.Random(seed), random.Random(seed).getrandbits(64)
    made = {base}
    while len(made) < n:
        fp = base
        for b in rng.sample(range(64), flips):
            fp ^= 1 << b
        made.add(fp)
    return [(i, signed(fp)) for i, fp in enumerate(made)]


def test_runs_of_many_chunks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CHUNK", 7)
    rows = neighbours(11, 120, 5)
    reps = dedup.representatives(spark.createDataFrame(rows, "doc_id long, fp long"), "doc_id")
    got = [tuple(r) for r in dedup.block_pairs(reps, 3, 6, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in brute_links(rows, 3) if x[2] > 0}
    few = [tuple(r) for r in dedup.block_pairs(reps, 10, 11, 1).collect()]
    assert len(few) == len(set(few)) and set(few) == {x for x in brute_links(rows, 10) if x[2] > 0}


def test_owner_links(spark):
    rows = [(i, fp, "x" if i % 2 else "y") for i, fp in neighbours(3, 80, 14)] + [(500 + i, fp, None) for i, fp in neighbours(4, 6, 3)]
    fps = spark.createDataFrame(rows, "doc_id long, fp long, owner string")
    want = set()
    for owner in "xy":
        want |= {(owner, *p) for p in brute_links([(i, fp) for i, fp, o in rows if o == owner], 10)}
    cols = ("owner", "a", "b", "bits")
    assert {r for r in links(dedup.near_dup_same_owner(fps, "owner"), *cols) if r[0]} == want


def test_one_owner_with_thousands_of_prints(spark):
    rows = neighbours(8, 4000, 12)
    fps = spark.createDataFrame([(*r, "o") for r in rows], "doc_id long, fp long, owner string")
    first = {}
    for i, fp in sorted(rows):
        first.setdefault(fp, i)
    import numpy as np

    prints = np.array(sorted(first, key=first.get), np.int64).view(np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 10
    ids = [first[int(np.int64(x))] for x in prints.view(np.int64)]
    got = {r.rep: (r.n_links, r.least) for r in dedup.near_dup_links(fps, 10, 11, 1, "owner").collect()}
    assert got == {ids[k]: (int(near[k].sum()) - 1, ids[int(np.argmax(near[k]))]) for k in range(len(ids))}


def test_links_are_linear_in_a_family_of_edited_copies(spark):
    for n in (200, 400, 800):
        fps = spark.createDataFrame(family(n, 1 if n < 60 else 2), "doc_id long, fp long")
        reps = dedup.representatives(fps, "doc_id")
        found = dedup.block_links(reps, 3, 6, 3)
        assert found.count() <= 20 * n  # a row per print and choice of blocks at most
        classes = dedup.near_dup_classes(fps, dedup.near_dup_links(fps)).collect()
        assert len(classes) == n and {r.class_id for r in classes} == {0}


def test_classes_and_status_equal_brute_force(spark):
    rows = neighbours(21, 200, 7)
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    pairs = {(a, b) for a, b, _ in brute_links(rows, 3)}
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = dedup.near_dup_links(fps)
    got = {r.doc_id: r for r in dedup.near_dup_classes(fps, found).collect()}
    assert {i: r.class_id for i, r in got.items()} == label
    near = [(a, b) for a, b, n in brute_links(rows, 3) if n]
    assert all(got[i].n_links == sum(got[i].rep in p for p in near) for i, _ in rows)
    status = {r.doc_id: r.match_id for r in dedup.dup_status(fps, found).collect()}
    assert status == {i: min((j for j, g in rows if j < i and bits(fp, g) <= 3), default=None) for i, fp in rows}


def test_first_come_equals_the_sequential_rule(spark):
    rows = neighbours(31, 2000, 9)
    kept = []
    want = {}
    for i, fp in rows:
        want[i] = all(bits(fp, g) > 3 for g in kept)
        if want[i]:
            kept.append(fp)
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    assert {r.doc_id: r.kept for r in dedup.first_come(fps, dedup.near_dup_pairs(fps)).collect()} == want


def test_first_come_on_a_chain_and_without_pairs(spark):
    # Each print is near its neighbours only: every second one stays.
    chain, fp = [], 0
    for i in range(9):
        chain.append((i, signed(fp)))
        for b in range(2):
            fp ^= 1 << (2 * i + b)
    fps = spark.createDataFrame(chain, "doc_id long, fp long")
    pairs = spark.createDataFrame([(i, i + 1, 2) for i in range(8)], "a long, b long, bits int")
    assert [r.kept for r in sorted(dedup.first_come(fps, pairs).collect())] == [i % 2 == 0 for i in range(9)]
    assert all(r.kept for r in dedup.first_come(fps, pairs.limit(0)).collect())


def test_clusters_of_a_long_chain(spark):
    pairs = [(i, i + 1, 1) for i in range(1, 40)] + [(100, 101, 0), (100, 102, 0)]
    got = {r.doc_id: (r.cluster_id, r.keep) for r in dedup.dup_clusters(
        spark.createDataFrame(pairs, "a long, b long, bits int")).collect()}
    assert all(got[i] == (1, i == 1) for i in range(1, 41)) and got[102] == (100, False)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3, unique=True))
def test_some_block_choice_survives_three_flips(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    assert any((fp & m) == (other & m) for m in (x & (2**64 - 1) for x in dedup._masks(6, 3)))


def test_fingerprints_of_a_batch(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdé🙂ß日") for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["", "a", "abc", "abcd", "é" * 5000]

    def plain(body):
        votes = [0] * 64
        for i in range(max(1, len(body) - 3)):
            h = int.from_bytes(hashlib.md5(body[i:i + 4].encode()).digest()[-8:], "big")
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        return signed(sum(1 << b for b in range(64) if votes[b] > 0))

    from pyspark.sql import functions as F

    from corpusfit.functions.text import norm_fingerprint

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bodies = {r.doc_id: r.b for r in docs.select("doc_id", F.regexp_replace(norm_fingerprint(F.col("text")), r"(?U)\W+", "").alias("b")).collect()}
    assert {r.doc_id: r.fp for r in dedup.simhash(docs).collect()} == {i: plain(b) for i, b in bodies.items()}


def test_nothing_made_of_prints_is_sent_through_the_driver(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    real = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: real(noted(df)))
    rows = neighbours(41, 300, 5)
    fps = real(spark.createDataFrame([(*r, "xy"[r[0] % 2]) for r in rows], "doc_id long, fp long, owner string"))
    links, owned = dedup.near_dup_links(fps), dedup.near_dup_links(fps, 10, 11, 1, "owner")
    pairs = noted(dedup.near_dup_pairs(fps))
    noted(dedup.near_dup_classes(fps, links)).count()
    noted(dedup.dup_status(fps, links, owned, "owner")).count()
    noted(dedup.first_come(fps, pairs)).count()
    noted(dedup.dup_clusters(pairs)).count()
    assert len(plans) > 12 and not [p for p in plans if "BroadcastExchange" in p]


def test_queries_of_prints_broadcast_nothing(spark):
    from corpusfit import catalog

    catalog.load_all()
    for name in ("near_dup_pairs", "near_dup_classes", "dup_first_come", "dup_clusters", "dup_status"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan, name
