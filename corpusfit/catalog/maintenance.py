"""Table upkeep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfit.catalog.documents import C, SECTIONS
from corpusfit.catalog.registry import query
from corpusfit.plans import maintenance as mt

NOW = "2002-01-01 00:00:00"


def _people(v):
    return v("candidates").withColumn("deleted_at", F.when(C("deleted"), F.to_timestamp_ntz(F.lit("2001-05-05 00:00:00"))))


def _ids(v):
    """People whose account is overdrawn: the id list of the upkeep queries."""
    return v("customer").filter("c_acctbal < 0").select(C("c_custkey").alias("candidate_id"))


@query("soft_delete", """SELECT candidate_id, CASE WHEN deleted THEN TIMESTAMP '2001-05-05 00:00:00' WHEN needs_review THEN TIMESTAMP '2002-01-01 00:00:00' END AS deleted_at FROM candidates""")
def _(v):
    return mt.soft_delete(_people(v), _ids(v), NOW).select("candidate_id", "deleted_at")


@query("soft_delete_audit", "SELECT candidate_id AS target_id, 'soft_delete' AS action FROM candidates WHERE needs_review AND NOT deleted")
def _(v):
    people = _people(v)
    return mt.deletion_audit(people, mt.soft_delete(people, _ids(v), NOW))


@query("restore", """SELECT candidate_id, CASE WHEN deleted AND NOT needs_review THEN TIMESTAMP '2001-05-05 00:00:00' END AS deleted_at FROM candidates""")
def _(v):
    return mt.restore(_people(v), _ids(v)).select("candidate_id", "deleted_at")


@query("cascade_delete", """SELECT 'candidates' AS table_name, count(*) AS rows_left, CAST(sum(candidate_id) AS BIGINT) AS key_sum FROM candidates WHERE NOT needs_review
  UNION ALL SELECT 'evals', count(*), CAST(sum(evaluation_id) AS BIGINT) FROM evals WHERE candidate_id NOT IN (SELECT candidate_id FROM candidates WHERE needs_review)
  UNION ALL SELECT 'status_log', count(*), CAST(sum(ref_a) AS BIGINT) FROM status_log WHERE evaluation_id NOT IN (
    SELECT evaluation_id FROM evals JOIN candidates USING (candidate_id) WHERE needs_review)""")
def _(v):
    left = mt.cascade_delete(
        {"candidates": v("candidates"), "evals": v("evals"), "status_log": v("status_log")}, _ids(v),
        [("evals", "candidate_id", "candidates", "candidate_id"), ("status_log", "evaluation_id", "evals", "evaluation_id")],
        "candidates", "candidate_id")
    out = None
    for name, key in (("candidates", "candidate_id"), ("evals", "evaluation_id"), ("status_log", "ref_a")):
        part = left[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows_left"), F.sum(key).alias("key_sum"))
        out = part if out is None else out.unionByName(part)
    return out


@query("erase_subject", """SELECT candidate_id, CASE WHEN needs_review THEN 'Deleted User' ELSE name END AS name, CASE WHEN NOT needs_review THEN email END AS email,
    CASE WHEN NOT needs_review THEN text END AS text FROM candidates JOIN profile_docs ON doc_id = candidate_id""")
def _(v):
    docs = v("profile_docs").withColumnRenamed("doc_id", "candidate_id")
    people, texts, _audit = mt.erase_subject(v("candidates"), docs, _ids(v))
    return people.select("candidate_id", "name", "email").join(texts, "candidate_id")


@query("reclassify_levels", """SELECT candidate_id, level, old_level IS DISTINCT FROM level AS changed FROM (SELECT candidate_id, level AS old_level,
    CASE WHEN graduation_year >= 1999 THEN 'entry' WHEN years_experience IS NULL THEN 'entry' WHEN years_experience < 1 THEN 'entry' WHEN years_experience < 3 THEN 'junior'
      WHEN years_experience < 5 THEN 'mid' WHEN years_experience < 10 THEN 'senior' ELSE 'executive' END AS level FROM candidates)""")
def _(v):
    return mt.reclassify_levels(v("candidates"), 2000).select("candidate_id", "level", "changed")


@query("resegment_all", "WITH " + SECTIONS.replace("SRC", "profile_docs") + " SELECT doc_id, count(*) AS sections, CAST(sum(length(text)) AS BIGINT) AS chars FROM sections GROUP BY doc_id")
def _(v):
    return mt.resegment_all(v("profile_docs")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"), F.sum(F.length("text")).alias("chars"))


@query("reparse_all", """SELECT candidate_id, first_name || ' ' || last_name AS name, true AS name_changed, CAST(1990 + candidate_id % 13 AS INT) AS graduation_year
  FROM candidates JOIN profile_names ON owner = candidate_id WHERE NOT deleted""")
def _(v):
    return mt.reparse_all(v("profile_docs"), v("candidates"), 2002).select("candidate_id", "name", "name_changed", "graduation_year")


@query("repair_names", """SELECT candidate_id, CASE WHEN candidate_id % 8 <> 0 THEN name WHEN email IS NULL THEN 'Unknown' ELSE replace(name, '#', ' ') END AS name FROM candidates""")
def _(v):
    rows = v("candidates").withColumn("name", F.when(C("candidate_id") % 8 == 0, "Career Objective").otherwise(C("name")))
    return mt.repair_names(rows).select("candidate_id", "name")


STATUS_IDS = "SELECT DISTINCT l_partkey AS evaluation_id FROM lineitem UNION SELECT DISTINCT -c_custkey - 1 FROM customer"


@query("bulk_status", f"""WITH ids AS ({STATUS_IDS}) SELECT evaluation_id, CASE WHEN evaluation_id IN (SELECT evaluation_id FROM evals) THEN 'hired' ELSE 'missing' END AS status FROM ids""")
def _(v):
    known, missing = mt.bulk_status(v("evals"), v.sql(f"SELECT * FROM ({STATUS_IDS})"), "hired")
    return known.unionByName(missing.withColumn("status", F.lit("missing")))


@query("manual_override", """WITH m AS (SELECT l_orderkey AS evaluation_id, l_quantity AS manual_score, l_shipdate AS scored_at, l_linenumber >= 4 AS fresh FROM lineitem),
    last AS (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY fresh DESC, scored_at DESC, manual_score DESC) AS rn FROM m)
  SELECT e.evaluation_id, manual_score, coalesce(manual_score, total_score) AS effective_score FROM evals e LEFT JOIN last l ON l.evaluation_id = e.evaluation_id AND rn = 1""")
def _(v):
    rows = v("lineitem").select(
        C("l_orderkey").alias("evaluation_id"), C("l_quantity").alias("manual_score"), C("l_shipdate").alias("scored_at"), "l_linenumber")
    old, new = rows.filter("l_linenumber < 4").drop("l_linenumber"), rows.filter("l_linenumber >= 4").drop("l_linenumber")
    return mt.effective_scores(v("evals"), mt.manual_override(old, new)).select("evaluation_id", "manual_score", "effective_score")


@query("archive_version", """WITH v AS (SELECT *, is_current AND total_score < 70 AS stays, total_score >= 70 AS hit FROM versions JOIN (SELECT version_id, total_score FROM evals) USING (version_id)),
    o AS (SELECT candidate_id, bool_or(hit) AS touched, arg_max(version_id, (uploaded_at, version_id)) FILTER (stays) AS current_version_id FROM v GROUP BY candidate_id)
  SELECT candidate_id, current_version_id, CASE WHEN current_version_id IS NULL THEN TIMESTAMP '2002-01-01 00:00:00' END AS deleted_at FROM o WHERE touched""")
def _(v):
    ids = v("evals").filter("total_score >= 70").select("version_id")
    return mt.archive_version(v("versions"), v("candidates"), ids, NOW)[1]


@query("purge_landing", """SELECT message_id, CASE WHEN value > 50 THEN 'new' ELSE status END AS status, CASE WHEN status = 'failed' AND NOT value > 50 THEN 'parse error' END AS error
  FROM landing WHERE CASE WHEN value > 50 THEN 'new' ELSE status END <> 'keyword_filtered'""")
def _(v):
    rows = v("landing").withColumn("error", F.when(C("status") == "failed", "parse error"))
    return mt.purge_landing(rows, rows.filter("value > 50").select("message_id"), ["keyword_filtered"]).select("message_id", "status", "error")


@query("replace_rules", """SELECT role_id, skill, 'old' AS origin FROM role_skills WHERE role_id NOT IN (2, 4)
  UNION ALL SELECT role_id, label, 'new' FROM rules""")
def _(v):
    old = v("role_skills").select("role_id", "skill", F.lit("old").alias("origin"))
    new = v("rules").select("role_id", C("label").alias("skill"), F.lit("new").alias("origin"))
    return mt.replace_rules(old, new)
