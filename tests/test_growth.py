"""Work per text follows the text, not text x terms or the tasks' number."""

import random

from corpusfit.operators import dictionary, topk


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_read_once_for_all_terms(spark):
    rng = random.Random(7)
    terms = ["a", "ab", "abc", "abcd", "abcdefgh", "abcdefghi", "größe", "é", "ß b", "b größe", "😀", "😀x", "+", "a\nb", "abcdefghijk"]
    bits = terms + ["x", " ", "abcdefg", "hij", "gr", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for i in range(1200)] + [(5000, None), (5001, ""), (5002, "ab" * 400_000 + "é")]
    texts = spark.createDataFrame(rows, "text_id long, text string")
    listed = spark.createDataFrame([(t,) for t in terms + ["", "a"]], "term string")
    want = {(i, t) for i, x in rows for t in terms if x and t in x}
    found = dictionary.contained_terms(texts, listed)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sorted(map(tuple, dictionary.contained_terms(texts.where("text_id < 300"), listed, in_task=3).collect())) == sorted(w for w in want if w[0] < 300)
    assert "Generate" not in plan_of(found)
    assert dictionary.contained_terms(texts, listed.limit(0)).count() == 0


def test_excerpts_are_sought_once(spark):
    text = "First of all İstanbul is named. Then ΣΑΣ came\nto a long line with Spark in it! Spark and spark again and more. Machine work at the very end"
    docs = spark.createDataFrame([(1, text), (2, "short. too"), (3, "")], "doc_id long, text string")
    hits = spark.createDataFrame(
        [(1, t) for t in ("spark", "came", "line with", "came\nto", "machine learning", "zzz end", "none of these", "", "i̇stanbul", "σας")] + [(2, "short"), (2, ""), (3, "x")],
        "doc_id long, term string")
    out = topk.best_excerpts(docs, hits)
    got = {(r.doc_id, r.term): r.excerpt for r in out.collect()}
    first, line = "First of all İstanbul is named", "to a long line with Spark in it"
    single = docs.join(hits, "doc_id").select("doc_id", "term", topk.best_excerpt(topk.F.col("text"), topk.F.col("term")).alias("e"))
    assert got == {(r.doc_id, r.term): r.e for r in single.collect()}
    assert got[1, "spark"] == line and got[1, ""] == first and got[1, "came\nto"] is None and got[2, ""] is None
    plan = plan_of(out)
    assert "Generate" not in plan and "BroadcastExchange" not in plan


def test_lean_views_give_the_rows_of_their_sql(spark, tmp_path, monkeypatch):
    from corpusfit.catalog import views

    rows = {
        "orders": ("o_orderkey long, o_custkey long", [(1, 7), (2, 7), (3, 8), (4, None)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_shipdate timestamp_ntz", [
            (o, p, topk_day(d)) for o, p, d in [(1, 1, 3), (1, 1, 5), (2, 1, 4), (2, 2, 1), (3, 2, None), (3, 9, 2), (4, 1, 2), (4, 1, 6), (None, 1, 1)]]),
        # A key that stands twice, with equal and with other values.
        "part": ("p_partkey long, p_name string, p_brand string, p_size int", [(1, "bolt", "A", 1), (1, "bolt", "A", 1), (2, "rod", "B", 2), (2, "nut", "B", None)]),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    inputs = views.Inputs(spark, str(tmp_path))
    ctes = ", ".join(f"{t} AS (SELECT * FROM parquet.`{tmp_path}/{t}.parquet`)" for t in rows)
    for name in views.SPARK_FORMS:
        plain = spark.sql(f"WITH {ctes}, repos AS ({views.VIEWS['repos']}) {views._dialect(views.VIEWS[name], views._SPARK)}")
        lean = inputs.sql(f"SELECT * FROM {name}")
        assert lean.dtypes == plain.dtypes
        assert sorted(map(str, lean.collect())) == sorted(map(str, plain.collect())) and lean.count() > 1
    # The lines' tasks follow their table, and no aggregate beside the join holds them.
    monkeypatch.setattr(views, "LINES_PER_TASK", 50)
    many = inputs.tasks()
    assert many > spark.sparkContext.defaultParallelism
    for name in views.SPARK_FORMS:
        plan = plan_of(inputs.sql(f"SELECT * FROM {name}"))
        assert f", {many}), REPARTITION_BY_NUM" in plan


def topk_day(d):
    import datetime

    return None if d is None else datetime.datetime(2001, 1, d)


def test_a_batch_file_is_written_without_joins(spark, tmp_path, monkeypatch):
    from corpusfit.streaming import run

    plans = []
    write = type(spark.range(1)).coalesce
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda df, n: plans.append(plan_of(df)) or write(df, n))
    rows = spark.range(60).withColumnRenamed("id", "k").join(spark.range(40).selectExpr("id AS k", "id % 3 AS part"), "k")
    folder = str(tmp_path / "in")
    run.batches_stream(rows, folder, [run.F.col("part") == 0, run.F.col("part") == 1])
    assert len(plans) == 3 and not any("Join" in p for p in plans)
    files = spark.read.parquet(folder).select("k", "part", run.F.input_file_name().alias("f"))
    assert files.count() == 40 and files.groupBy("f").agg(run.F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def made(df, part):
    """How often the optimized plan computes ``part``."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(part)


def test_degree_lines_are_found_once_for_all_readings_of_a_year(spark):
    from corpusfit.functions import text

    said = "Bachelor of X\n1999-03\nSkills\n2001\nother 2002\nClass of 1998\n\nBCA\na\nb\nc\nd\ne\n2000"
    docs = spark.createDataFrame([(said, "1997 - May 2001"), ("2002", "Expected 1996"), ("x", ""), (None, None)], "text string, edu string")
    out = docs.select(text.graduation_year(topk.F.col("edu"), topk.F.col("text"), 2002).alias("y"))
    assert [r.y for r in out.collect()] == [2003, 1996, None, None]
    assert [r.n for r in docs.select(topk.F.array_join(text.degree_lines(topk.F.col("text")), "/").alias("n")).collect()] == [
        "Bachelor of X/1999-03/BCA/a/b/c/d/e", "", "", None]
    assert made(out, "polytechnic") == 1


def test_lines_before_a_span_are_cut_once(spark):
    from corpusfit.functions import text

    said = "Intern\n \nat a\n\nb\nc\nd 1990 - 1992, 1993-1995\nEngineer\n1995 to present\n\u00a0\nTrainee 1999-2001"
    docs = spark.createDataFrame([(said, ""), ("none", "over 7+ years"), (None, "x")], "text string, summary string")
    spans = docs.select(text.year_ranges(topk.F.col("text"), 2002).alias("s"))
    assert [[tuple(x) for x in r.s] for r in spans.collect()[:2]] == [
        [(1990, 1992, True), (1993, 1995, True), (1995, 2002, False), (1999, 2001, True)], []]
    years = docs.select(text.years_of_experience(topk.F.col("text"), topk.F.col("summary"), 2002).alias("y"))
    assert [r.y for r in years.collect()] == [7.0, 7.0, None]
    # One cut of the text at its spans and one of the lines before a span.
    assert made(spans, "split(") == 2 and made(years, "split(") == 2


def test_terms_of_many_groups_are_counted_at_once(spark, monkeypatch):
    import pyarrow as pa

    from corpusfit.plans import vectors

    rng = random.Random(3)
    rows = [(g, i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(7)))) for g in range(60) for i in range(rng.randrange(1, 4))] + [(None, 1, None), (70, 2, "")]
    table = spark.createDataFrame(rows, "doc_id long, line int, text string").repartition(1)
    runs, calls, write, count = [], [], type(table).mapInArrow, vectors.counted
    monkeypatch.setattr(type(table), "mapInArrow", lambda df, run, schema: runs.append((df, run)) or write(df, run, schema))
    monkeypatch.setattr(vectors, "counted", lambda *x: calls.append(1) or count(*x))
    for bitmap in (None, bytes([0x5A]) * (1 << (vectors.BITMAP_BITS - 3))):
        out = vectors.group_vectors(table, "doc_id", "line", topk.F.col("text"), 2, "[a-z]", bitmap)
        assert out.count() == len({g for g, *_ in rows})
        packed, run = runs.pop()
        whole = packed.toArrow().combine_chunks().to_batches()
        assert len(whole) == 1
        del calls[:]
        at_once = pa.Table.from_batches(run(iter(whole))).to_pylist()
        assert len(calls) == 1
        single = pa.Table.from_batches(run(iter([whole[0].slice(k, 1) for k in range(whole[0].num_rows)]))).to_pylist()
        assert at_once == single and any(r["terms"] for r in single) and any(not r["terms"] for r in single)


def test_words_are_counted_where_their_document_is(spark, tmp_path):
    from corpusfit.catalog import views

    rng = random.Random(5)
    words = [f"w{i}" for i in range(2300)]
    rows = [(i, " ".join(rng.choices(words, k=90)).replace("w7 ", "W7, ")) for i in range(120)]
    # Ids that stand more than once, with equal and with other words; no id, no text, no words.
    rows += [(3, "twice w1 w1"), (3, "twice w2"), (3, None), (None, "twice w1"), (None, "twice w1 alone"), (900, None), (901, "- !"), (902, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ctes = f"documents AS (SELECT * FROM parquet.`{tmp_path}/documents.parquet`), token_docs AS ({views._dialect(views.VIEWS['token_docs'], views._SPARK)})"
    plain = spark.sql(f"WITH {ctes} {views.VIEWS['dict_terms']}")
    lean = views.Inputs(spark, str(tmp_path)).sql("SELECT * FROM dict_terms")
    assert lean.dtypes == plain.dtypes
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, plain.collect())) and lean.count() == 2000
    assert "array_distinct" in plan_of(lean) and "TakeOrderedAndProject" in plan_of(lean)


def test_claims_are_judged_where_they_are_made(spark, monkeypatch):
    from corpusfit import catalog
    from corpusfit.catalog import views

    catalog.load_all()
    monkeypatch.setattr(views, "LINES_PER_TASK", 5000)
    many = views.Inputs(spark, "/root/testdata/sf0.001").tasks()
    assert many > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = plan_of(catalog.QUERIES["skill_gap_severity"](spark, "/root/testdata/sf0.001"))
    assert f"hashpartitioning(owner#" in plan and f", {many}), REPARTITION_BY_NUM" in plan
    # No claim is shuffled by its skill.
    assert not [x for x in plan.splitlines() if "hashpartitioning(owner#" in x and "skill#" in x]


def test_names_of_repositories_are_cut_into_words_once(spark):
    from corpusfit.operators import projects

    repos = spark.createDataFrame([(1, 1, "Red bolt"), (1, 2, "red bolt"), (1, 3, "Tool"), (1, 4, None), (2, 5, "rod"), (3, 6, "none")], "owner long, repo_id long, name string")
    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 2)], "owner long, role_id long")
    skills = spark.createDataFrame([(1, "Bolt"), (1, "bolt"), (1, "a tool "), (2, "rod")], "role_id long, skill string")
    found = projects.relevant_repos(repos, skills, pairs)
    # A repository without a name is a part of any skill that holds a space.
    assert sorted((r.owner, r.role_id, r.repo_id, tuple(r.matched_skills)) for r in found.collect()) == [
        (1, 1, 1, ("bolt",)), (1, 1, 2, ("bolt",)), (1, 1, 3, ("a tool ",)), (1, 1, 4, ("a tool ",))]
    names = spark.createDataFrame([(1, "The bolt!"), (1, "Tools"), (1, "tool"), (2, "bolt"), (9, "bolt")], "owner long, project_name string")
    out = projects.unverified_projects(names, found, pairs)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3, 1), (1, 2, 3, 3), (2, 1, 1, 1)]
    assert made(out, "collect_set(name") == 1 and made(out, "exists(") > 0


def test_listed_skills_are_gathered_where_the_lines_are_dealt_out(spark, tmp_path):
    """Skills of an owner meet their document by one exchange of lines; owners without lines and names that stand twice give their rows."""
    from corpusfit import catalog

    catalog.load_all()
    rows = {
        "customer": ("c_custkey long, c_mktsegment string", [(5, "AUTO"), (6, "AUTO"), (10, "AUTO"), (15, "AUTO")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", [(1, 5, topk_day(1)), (2, 6, topk_day(2)), (3, 15, topk_day(3)), (4, None, topk_day(3))]),
        "lineitem": ("l_orderkey long, l_partkey long, l_shipdate timestamp_ntz", [(o, p, topk_day(4)) for o, p in [(1, 1), (1, 2), (1, 2), (2, 1), (2, 3), (3, 3), (4, 1)]]),
        "part": ("p_partkey long, p_name string, p_brand string, p_size int", [(1, "Bolt", "A", 1), (2, "rod", "A", 1), (3, "red widget", "B", 2)]),
        "conversations": ("conv_id long, turn int, role string, text string", []),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = catalog.QUERIES["tenure_years"](spark, str(tmp_path))
    plan = plan_of(got)
    assert plan.count("REPARTITION_BY_NUM") == 1 and "Union" not in plan
    # An owner divisible by five has "docker and 4 years of red widget work" behind the names that were deployed.
    assert sorted((r.doc_id, r.skill, r.years) for r in got.collect()) == [
        (5, "Bolt", 4.0), (5, "red widget", 4.0), (5, "rod", 4.0), (6, "Bolt", None), (6, "red widget", None), (10, "red widget", 4.0), (15, "red widget", 4.0)]
