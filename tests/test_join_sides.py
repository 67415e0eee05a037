"""Sides whose size the planner underrates are shuffled, whatever their estimate."""

import re

from corpusfit.plans import matching, scoring, tfidf
from corpusfit.scale import cut_lineage


def broadcast_columns(df):
    """Columns of the sides that the plan broadcasts."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sides = [plan[m.start():].split("\n", 6)[1:6] for m in re.finditer("BroadcastExchange", plan)]
    return "\n".join("\n".join(s) for s in sides)


def tables(spark):
    sections = spark.createDataFrame(
        [(k, 0, "projects", "built with react and kafka for 3 years", 1.0) for k in range(40)]
        + [(k, 5, "education", "bachelor of engineering", 0.5) for k in range(40)],
        "doc_id long, start_line int, type string, text string, weight double")
    pairs = spark.createDataFrame([(k, 1, False, 3.0) for k in range(40)], "doc_id long, role_id int, fresher boolean, years_experience double")
    skills = spark.createDataFrame([(1, "react", True), (1, "kafka", False)], "role_id int, skill string, is_required boolean")
    return sections, pairs, skills


def test_sections_are_not_broadcast_to_their_skills(spark):
    sections, pairs, skills = tables(spark)
    found = matching.match_skills(sections, skills, pairs, 2002)
    assert found.count() == 80
    assert not re.search("sentences|start_line|years_in|text|skills", broadcast_columns(matching.skill_hits(
        sections, found.groupBy("doc_id").agg(matching.F.array_distinct(matching.F.collect_list(matching.F.struct(
            "skill", matching.F.lower("skill").alias("name"), matching.long_words(matching.F.col("skill")).alias("words"),
            matching.skill_aliases(matching.F.col("skill")).alias("aliases")))).alias("skills")), 2002)))


def planned_broadcasts(df):
    """The two topmost steps of each side that the planner would broadcast before it has run anything."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return "\n".join(step for i, line in enumerate(lines) if "BroadcastExchange" in line for step in lines[i + 1:i + 3])


def stored(spark, *tables):
    """Tables as files, whose size the planner knows."""
    return [cut_lineage(t) for t in tables]


def test_education_texts_and_pairs_are_not_broadcast_to_scores(spark):
    sections, pairs, skills = tables(spark)
    roles = spark.createDataFrame([(1, 50, 30, 20, 2, None, None)], (
        "role_id int, weight_projects int, weight_skills int, weight_education int, min_experience int, min_degree string, preferred_majors string"))
    found = spark.createDataFrame([(k, 1, True, 0.5) for k in range(40)], "doc_id long, role_id int, is_required boolean, work_score double")
    sections, pairs, skills, roles, found = stored(spark, sections, pairs, skills, roles, found)
    scored = scoring.score_documents(found, sections, roles, skills, pairs)
    assert not re.search("edu_text|collect_list|project_sum", planned_broadcasts(scored))
    vector = "array<struct<term:bigint,w:double>>"
    docs = spark.createDataFrame([(k, 1.0, [(7, 1.0)]) for k in range(40)], f"doc_id long, total double, terms {vector}")
    terms = spark.createDataFrame([(1, 1.0, [(7, 1.0)])], f"role_id int, total double, terms {vector}")
    docs, terms = stored(spark, docs, terms)
    assert "doc_id" not in planned_broadcasts(tfidf.pair_cosine(docs, terms, pairs))


def test_section_texts_are_not_broadcast_to_rules(spark):
    from corpusfit.plans import requirements

    sections, pairs, _ = tables(spark)
    rules = spark.createDataFrame(
        [(1, 1, "skill", 50.0, "react", None), (1, 2, "education", 50.0, "bachelor of engineering", None)],
        "role_id int, rule_id long, req_type string, weight double, label string, min_years int")
    roles = spark.createDataFrame([(1, None, None)], "role_id int, min_degree string, preferred_majors string")
    sections, pairs, rules, roles = stored(spark, sections, pairs, rules, roles)
    rows = requirements.requirement_breakdown(sections, rules, roles, pairs, 2002)
    assert not re.search("exp_text|start_line|sec_own|n_sec", planned_broadcasts(rows))
