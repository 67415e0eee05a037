"""Finds of several sources: merged by the plain rule, packed before they are shuffled."""

import random

from pyspark.sql import functions as F

from corpusfit.operators import dictionary, sets


def by_rule(rows, known):
    """(owner, skill, is_required, id) from (owner, skill, is_required, priority, refines) by the plain rule."""
    found = {}
    for owner, skill, required, priority, refines in rows:
        found.setdefault((owner, skill and skill.lower()), []).append((priority, skill, required, refines))
    out = set()
    for (owner, key), mine in found.items():
        first = min(mine, key=lambda x: (x[0], x[1] or ""))
        refined = [x for x in mine if x[3]]
        last = max(refined, key=lambda x: x[0])[2] if refined else None
        out.add((owner, first[1], first[2] if last is None else last, known.get(key)))
    return out


def test_sources_are_merged_by_the_plain_rule(spark):
    rng = random.Random(4)
    names = ["Go", "go", "GO", "c++", "C++", "rust", "", None]
    rows, held = [], set()
    for _ in range(400):
        owner, skill, priority = rng.choice([1, 2, 3, 4, None]), rng.choice(names), rng.randrange(3)
        if (owner, skill, priority) not in held and not (priority == 2 and any(
                (owner, skill and skill.lower()) == (o, s and s.lower()) and p == 2 for o, s, p in held)):
            held.add((owner, skill, priority))
            rows.append((owner, skill, rng.choice([True, False, None]), priority, priority == 2 and rng.random() < 0.7))
    sources = [spark.createDataFrame([(o, s, q, r) for o, s, q, p, r in rows if p == k], "text_id long, skill string, is_required boolean, refines boolean") for k in range(3)]
    sources[:2] = [s.drop("refines") for s in sources[:2]]
    known = {"go": 7, "rust": 9}
    got = sets.union_skill_sources(sources, spark.createDataFrame([("GO", 8), ("go", 7), ("rust", 9)], "skill string, skill_id long")).collect()
    assert len(got) == len({(r.text_id, r.skill and r.skill.lower()) for r in got})
    assert {(r.text_id, r.skill, r.is_required, r.skill_id) for r in got} == by_rule(rows, known)
    assert all(r.is_new == (r.skill_id is None) for r in got)


def test_finds_of_an_owner_travel_as_one_row(spark):
    source = spark.range(0, 4000, 1, 2).select(
        (F.col("id") / 100).cast("long").alias("text_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("skill"), F.lit(True).alias("is_required"))
    merged = sets.union_skill_sources([source, source], spark.createDataFrame([], "skill string, skill_id long"))
    assert merged.count() == 4000
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Exchange hashpartitioning(text_id" in plan
    runs = sets._packed_runs(source.select("text_id", "skill", "is_required"), 1)
    assert runs.count() == 40 and {len(r.skill) for r in runs.collect()} == {100}


def test_texts_are_not_shuffled_for_terms_that_need_no_second_look(spark):
    texts = spark.createDataFrame([(1, "Go and node.js"), (2, "c++, go !")], "text_id long, text string")
    plain = dictionary.dictionary_match(texts, spark.createDataFrame([("go",), ("and",)], "term string"))
    assert {tuple(r) for r in plain.collect()} == {(1, "go"), (1, "and"), (2, "go")}
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "SortMergeJoin" not in plan.split("== Initial Plan ==")[0]
    every = dictionary.dictionary_match(texts, spark.createDataFrame([("go",), ("node.js",), ("c++",), ("++",), ("!",)], "term string"))
    assert {tuple(r) for r in every.collect()} == {(1, "go"), (2, "go"), (1, "node.js"), (2, "c++"), (2, "!")}
