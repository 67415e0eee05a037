"""Ranking, dictionary joins, relevance, sources and streams against plain Python."""

import datetime
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusfit.operators import dictionary, windows
from corpusfit.operators.aggs import calibration_buckets, score_histogram, suggest_threshold, threshold_curve
from corpusfit.operators.joins import assign_new_ids, reactivated, resolve_entities
from corpusfit.plans import scoring, tfidf
from corpusfit.scale import ensure_checkpoint_dir, ordered_rank, salted_join
from corpusfit.sources import readers, sinks
from corpusfit.streaming import intake, limits, run


def test_rank_is_a_permutation_in_order(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.choice([100, 100, 100, rng.randrange(50)]))) for i in range(5000)]
    got = ordered_rank(spark.createDataFrame(rows, "id long, s double").repartition(7), [F.desc("s"), F.col("id")]).collect()
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r.id: r["rank"] for r in got} == want


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else "k%d" % (i % 50)) for i in range(900)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi"):
        assert sorted(map(tuple, salted_join(left, right, "k", how).select("id").collect())) == sorted(
            map(tuple, left.join(right, "k", how).select("id").collect()))



def test_checkpoint_folder_is_kept(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_dictionary_forms_equal_scan(spark):
    rng = random.Random(5)
    terms = ["c++", "node.js", ".net", "go", "react", "react native", "ci/cd", "#", "a"]
    words = terms + ["cargo", "goes", "reactive", "xc++y", "dotnet", "c", "node", "js"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(60)] + [(98, ""), (99, None)]
    df = spark.createDataFrame(texts, "text_id long, text string")
    table = spark.createDataFrame([(t,) for t in terms], "term string")

    def found(rows):
        return {(r.text_id, r.term) for r in rows.select("text_id", "term").collect()}

    inside = {(i, t) for i, x in texts for t in terms if x and t in x}
    assert found(dictionary.dictionary_match(df, table, "substring")) == inside
    assert found(dictionary.contained_terms(df.filter("text is not null"), table)) == inside
    assert found(dictionary.dictionary_match(df, table)) == {
        (i, t) for i, x in texts for t in terms if x and re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", x)}
    assert found(dictionary.dictionary_match(df, table, "token")) == {
        (i, t) for i, x in texts for t in terms if x and re.search(rf"\b{re.escape(t)}\b", x)}


def test_known_skills_and_aliases(spark):
    text = spark.createDataFrame([(1, "We use sklearn, Node.js and K8s; C++ is a plus. Not reactive.")], "text_id long, text string")
    got = {r.skill for r in dictionary.jd_skills(text, dictionary.known_skill_terms(spark)).collect()}
    assert got == {"Scikit-learn", "Node.js", "Kubernetes", "C++"}


def direct_cosine(a, b):
    """Two-document smooth-idf, sublinear, L2 cosine by the definition."""
    def grams(t):
        w = re.findall(r"\b\w\w+\b", t.lower())
        return Counter(w + [" ".join(w[i:i + 2]) for i in range(len(w) - 1)])
    ca, cb = grams(a), grams(b)
    df = Counter([*ca, *cb])
    vec = [{t: (1 + math.log(n)) * (math.log(3 / (1 + df[t])) + 1) for t, n in c.items()} for c in (ca, cb)]
    dot = sum(x * vec[1].get(t, 0) for t, x in vec[0].items())
    norm = math.prod(math.sqrt(sum(x * x for x in v.values())) for v in vec)
    return dot / norm if norm else 0.0


def test_relevance_closed_form(spark):
    rng = random.Random(9)
    pool = "spark scala python data lake mesh café naive role team build".split()
    docs = [(i, " ".join(rng.choice(pool) for _ in range(30))) for i in range(12)] + [(50, ""), (51, "zz yy")]
    roles = [(i, " ".join(rng.choice(pool) for _ in range(9))) for i in range(4)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    r = spark.createDataFrame(roles, "role_id long, role_doc string")
    pairs = d.select("doc_id").crossJoin(r.select("role_id"))
    got = {(x.doc_id, x.role_id): x.score for x in tfidf.tfidf_relevance(d, r, pairs).collect()}
    assert len(got) == 14 * 4
    for (i, a) in docs:
        for (j, b) in roles:
            assert abs(got[i, j] - direct_cosine(a, b)) < 6e-5
    sparse = {(x.doc_id, x.role_id): x.score for x in tfidf.tfidf_relevance(d, r).collect()}
    assert sparse == {k: v for k, v in got.items() if v > 0}


def test_accents(spark):
    row = spark.createDataFrame([("éàüçñ Żółw œ",)], "t string").select(tfidf.strip_accents(F.col("t")).alias("x")).first()
    assert row.x == "eaucn Zołw œ"


def test_histogram_edges_and_curve(spark):
    scores = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (99.9,), (100.0,)], "total_score double")
    got = {r["range"]: r["count"] for r in score_histogram(scores).collect()}
    assert got["0-10"] == 2 and got["10-20"] == 1 and got["90-100"] == 2 and len(got) == 10
    joined = spark.createDataFrame([(95.0, "hired"), (85.0, "hired"), (45.0, "rejected"), (15.0, "ghosted")], "total_score double, outcome string")
    curve = threshold_curve(calibration_buckets(joined))
    rows = sorted(curve.collect(), key=lambda r: r.threshold)
    assert all(a.candidates_above >= b.candidates_above for a, b in zip(rows, rows[1:]))
    assert suggest_threshold(curve).first().suggested_threshold == 50.0


def test_burst_counts_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(400)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, s int").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "s")
    got = {(r.k, r.ts.hour * 3600 + r.ts.minute * 60 + r.ts.second): r.in_window for r in windows.burst_window(df, "k", "ts", 60, 5).collect()}
    assert got == {(k, s): sum(1 for k2, s2 in rows if k2 == k and s - 60 <= s2 <= s) for k, s in set(rows)}


def test_identity_rules(spark):
    people = spark.createDataFrame(
        [(1, "Ann Ek", "a@x.example", False), (2, "Bo Ek", "b@x.example", True), (3, "Ann Ek", None, False)],
        "candidate_id long, name string, email string, deleted boolean")
    rows = [(10, "B@x.example", None, "Q"), (11, None, "a@x.example", "Q"), (12, None, None, " ann ek "), (13, "n@x.example", None, "New One"),
            (14, "N@x.example", None, "New One"), (15, None, None, "Bo Ek")]
    incoming = spark.createDataFrame(rows, "incoming_id long, sender_email string, doc_email string, name string")
    out = resolve_entities(incoming, people)
    got = {r.incoming_id: (r.candidate_id, r.matched_by) for r in out.collect()}
    assert got == {10: (2, "sender_email"), 11: (1, "document_email"), 12: (1, "name"), 13: (None, "new"), 14: (None, "new"), 15: (None, "new")}
    assert [r.candidate_id for r in reactivated(out, people).collect()] == [2]
    new = {r.incoming_id: r.candidate_id for r in assign_new_ids(out, incoming, 4).collect()}
    assert new[13] == new[14] and sorted(set(new.values())) == [4, 5]


def test_guarded_upsert(spark):
    cols = "role_id int, doc_id long, evaluated_at int, total_score double, eval_status string"
    old = spark.createDataFrame([(1, 1, 1, 80.0, None), (1, 2, 1, 0.0, "experience_filtered"), (1, 3, 1, 0.0, "queued")], cols)
    new = spark.createDataFrame([(1, 1, 2, 0.0, "queued"), (1, 2, 2, 3.0, "tfidf_filtered"), (1, 3, 2, 70.0, None), (1, 3, 1, 10.0, None), (1, 4, 2, 0.0, "queued")], cols)
    got = {r.doc_id: (r.total_score, r.eval_status) for r in sinks.upsert_evaluations(old, new).collect()}
    assert got == {1: (80.0, None), 2: (0.0, "experience_filtered"), 3: (70.0, None), 4: (0.0, "queued")}


def test_import_file(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(" Name ,EMAIL,Phone\nAnn,A@x.example,1\n,,9\n,new.person@x.example,2\nLoose,,\n")
    rows, bad = readers.read_import_csv(spark, str(path))
    assert bad.count() == 0
    people = spark.createDataFrame([(1, "Unknown", "a@x.example", None)], "candidate_id long, name string, email string, phone string")
    after, errors = readers.bulk_import(rows, people)
    got = {(r.candidate_id, r.name, r.email, r.phone, r.action) for r in after.collect()}
    assert got == {(1, "Ann", "a@x.example", "1", "updated"), (None, "New Person", "new.person@x.example", "2", "created"), (None, "Loose", None, None, "created")}
    assert [(r.row_no, r.reason) for r in errors.collect()] == [(3, "row without name and address")]


def test_file_triage_on_real_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nope")
    (tmp_path / "c.txt").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: r.ok for r in readers.file_triage(readers.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": True, "b.pdf": False, "c.txt": False}


def test_judgement_answers_with_fences(spark):
    rows = spark.createDataFrame([(1, '```json\n[{"name":"Spark","score":80,"confidence":"high","section":"projects"}]\n```'), (2, "none")], "doc_id long, answer string")
    got = scoring.parse_judgements(rows).collect()
    assert [(r.doc_id, r.name, r.score) for r in got] == [(1, "Spark", 80.0)]


def test_route_limits(spark):
    row = spark.createDataFrame([("/upload/x",), ("/other",)], "p string").select(limits.route_limits(F.col("p")).alias("r")).collect()
    assert [(x.r.route, x.r.max_n) for x in row] == [("/upload", 30), ("__default__", 300)]


def test_intake_retry_rule(spark):
    schema = "message_id long, received_at int, status string"
    log = spark.createDataFrame([(1, 1, "processed"), (2, 1, "failed")], schema)
    batch = spark.createDataFrame([(1, 2, "new"), (2, 2, "processed"), (3, 2, "new"), (3, 3, "new")], schema)
    assert {(r.message_id, r.status) for r in intake.intake_merge(log, batch).collect()} == {(1, "processed"), (2, "processed"), (3, "new")}
    assert sorted(r.message_id for r in intake.due_messages(log, batch).collect()) == [2, 3]


def test_landing_over_batches(spark, tmp_path):
    src = tmp_path / "mail"
    schema = "message_id long, received_at int, status string"
    for part in ([(1, 1, "processed"), (2, 1, "failed"), (2, 1, "failed")], [(1, 2, "failed"), (2, 2, "processed"), (3, 2, "new")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    folder = run.work_folder(spark, "land-test")
    intake.land_stream(run.file_stream(spark, str(src), spark.read.parquet(str(src)).schema, files_per_trigger=1), folder)
    assert {(r.message_id, r.status) for r in intake.landed(spark, folder).collect()} == {
        (1, "processed"), (2, "processed"), (3, "new")}


@pytest.mark.parametrize("stored,runs,want", [
    (50.0, [(80.0, None), (0.0, "queued")], (80.0, None)),
    ("queued", [(66.0, None), (0.0, "queued")], (66.0, None)),
    (None, [(70.0, None), (0.0, "queued")], (70.0, None)),
    (None, [(0.0, "queued"), (5.0, "tfidf_filtered")], (5.0, "tfidf_filtered")),
    (50.0, [(3.0, "experience_filtered"), (4.0, "tfidf_filtered")], (3.0, "experience_filtered")),
    (50.0, [(3.0, "experience_filtered"), (60.0, None), (4.0, "tfidf_filtered")], (4.0, "tfidf_filtered")),
    ("experience_filtered", [(4.0, "tfidf_filtered")], (9.0, "experience_filtered")),
    (50.0, [(0.0, "queued")], (50.0, None)),
])
def test_run_results_are_applied_in_order(spark, stored, runs, want):
    from corpusfit.sources import sinks

    schema = "role_id int, doc_id long, evaluated_at timestamp, total_score double, eval_status string"
    day = datetime.datetime(2020, 1, 1)
    old = [] if stored is None else [(1, 1, day, 9.0, stored) if isinstance(stored, str) else (1, 1, day, stored, None)]
    new = [(1, 1, day + datetime.timedelta(days=k + 1), score, status) for k, (score, status) in enumerate(runs)]
    got = sinks.upsert_evaluations(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    assert [(r.total_score, r.eval_status) for r in got] == [want]


def test_reconcile_keeps_rows_without_company_and_end(spark):
    from corpusfit.operators import joins

    left = spark.createDataFrame([(1, None, None), (1, "A", "2020-01")], "owner long, company string, end_month string")
    right = spark.createDataFrame(
        [(1, "a", "2020-09", 1), (1, "A", "2020-02", 2)], "owner long, company string, end_month string, line int")
    merged, found = joins.reconcile_sources(left, right)
    assert {(r.company, r.validated, r.other_name) for r in merged.collect()} == {(None, False, None), ("A", True, "a")}
    assert {(r.flag_type, r.field) for r in found.collect()} == {
        ("missing_entry", "experience."), ("date_mismatch", "experience.A.end_date")}
    assert joins.reconcile_sources(left, right, listed="line")[1].where("flag_type = 'date_mismatch'").count() == 0


def test_technologies_are_no_names(spark):
    from corpusfit.functions import text

    rows = [("Python Java\nx",), ("Machine Learning\nBob Smith",), ("Docker Kubernetes",), ("Anna Nair",)]
    got = [r.n for r in spark.createDataFrame(rows, "t string").select(text.extract_name(F.col("t")).alias("n")).collect()]
    assert got == [None, "Bob Smith", None, "Anna Nair"]


def test_one_entry_per_span(spark):
    from corpusfit.operators import flags

    body = "Acme\nEngineer\nJan 2001 - Mar 2003\n- built x\nBeta Corp\n1994 - 1996\nGamma\nLead\n2004 – present"
    rows = spark.createDataFrame([(1, "experience", 0, body), (2, "experience", 0, "Solo\nMaker")], "doc_id long, type string, start_line int, text string")
    got = {tuple(r) for r in flags.experience_entries(rows).collect()}
    assert got == {(1, "Acme", "Engineer", "Jan 2001", "Mar 2003"), (1, "Beta Corp", None, "1994", "1996"),
                   (1, "Gamma", "Lead", "2004", "present"), (2, "Solo", "Maker", None, None)}
