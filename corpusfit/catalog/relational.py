"""Filters, joins, windows, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfit.catalog.registry import query
from corpusfit.functions import labels
from corpusfit.operators import filters, joins, sets, topk, windows
from corpusfit.plans.leaderboard import board_rows, leaderboard

# Oracle pieces shared by several queries (plain SQL text).
BOARD = """board AS (
  SELECT e.*, v.is_current, c.name, c.email, c.stage, c.level, c.years_experience, c.graduation_year,
         c.needs_review, c.deleted, c.github_url
  FROM evals e JOIN versions v ON v.version_id = e.version_id
  JOIN candidates c ON c.candidate_id = e.candidate_id)"""
LAST = """last_log AS (
  SELECT evaluation_id, status AS latest_status FROM (
    SELECT *, row_number() OVER (PARTITION BY evaluation_id
      ORDER BY changed_at DESC, seq DESC, ref_a DESC, ref_b DESC) AS rn FROM status_log) WHERE rn = 1)"""
ACTIVE = """is_current AND NOT deleted AND (eval_status IS NULL
  OR eval_status IN ('tfidf_filtered', 'experience_filtered'))"""
STATUS = """CASE WHEN stage IN ('rejected', 'hired') THEN stage
  WHEN latest_status IS NOT NULL THEN latest_status WHEN needs_review THEN 'review'
  WHEN eval_status IN ('tfidf_filtered', 'experience_filtered') THEN 'rejected' ELSE 'pending' END"""
FILTER_STAGE = """CASE WHEN eval_status IN ('tfidf_filtered', 'experience_filtered')
  THEN eval_status ELSE 'llm_scored' END"""


def _board(v):
    return board_rows(v("evals"), v("versions"), v("candidates"))


def _board_with_status(v):
    """Board rows with last log status, derived status and filter stage."""
    last = windows.latest_status(v("status_log")).select("evaluation_id", "latest_status")
    c = F.col
    return _board(v).join(last, "evaluation_id", "left").withColumn(
        "status", labels.derive_status(c("stage"), c("latest_status"), c("needs_review"), c("eval_status"))
    ).withColumn("filter_stage", labels.filter_stage(c("eval_status")))


@query("leaderboard", f"""WITH {BOARD}, {LAST},
  page AS (SELECT * FROM board WHERE {ACTIVE} ORDER BY total_score DESC, evaluation_id LIMIT 50)
  SELECT p.evaluation_id, p.candidate_id, p.name AS candidate_name, p.email, p.level, p.role_id,
    r.title AS role_title, total_score, project_score, skill_score, education_score,
    (SELECT count(*) FROM matches m WHERE m.evaluation_id = p.evaluation_id) AS skills_matched,
    (SELECT count(*) FROM role_skills s WHERE s.role_id = p.role_id) AS skills_total,
    CASE WHEN project_score >= 80 THEN 'High' WHEN project_score >= 50 THEN 'Med' ELSE 'Low' END AS project_match_label,
    {STATUS} AS status, {FILTER_STAGE} AS filter_stage,
    CASE WHEN r.require_github AND coalesce(github_url, '') = '' THEN 'GitHub' END AS missed_requirement,
    evaluated_at
  FROM page p JOIN roles r ON r.role_id = p.role_id
  LEFT JOIN last_log l ON l.evaluation_id = p.evaluation_id""")
def _(v):
    return leaderboard(
        v("evals"), v("versions"), v("candidates"), v("roles"), v("role_skills"), v("matches"),
        v("status_log"), limit=50)


@query("active_current", f"""WITH {BOARD} SELECT evaluation_id, candidate_id, role_id, total_score, eval_status
  FROM board WHERE {ACTIVE}""")
def _(v):
    return filters.active_current(_board(v)).select(
        "evaluation_id", "candidate_id", "role_id", "total_score", "eval_status")


@query("gate_experience", """
  SELECT doc_id, a.role_id,
    CASE WHEN r.min_experience > 0 AND years_experience < r.min_experience THEN
        printf('%.1f', years_experience) || ' years of experience, at least ' || r.min_experience || ' wanted'
      WHEN r.allowed_levels IS NOT NULL AND level IS NOT NULL AND level NOT IN ('junior', 'mid', 'senior') THEN
        'level ' || level || ' is none of: junior, mid, senior'
      WHEN graduation_year < r.min_graduation_year THEN 'graduated in ' || graduation_year
        || ', wanted from ' || r.min_graduation_year || ' on'
      WHEN graduation_year > r.max_graduation_year THEN 'graduated in ' || graduation_year
        || ', wanted up to ' || r.max_graduation_year
    END AS gate_reason
  FROM applications a JOIN candidates c ON c.candidate_id = a.doc_id JOIN roles r ON r.role_id = a.role_id""")
def _(v):
    people = v("candidates").select(
        F.col("candidate_id").alias("doc_id"), "years_experience", "level", "graduation_year")
    pairs = v("applications").join(people, "doc_id")
    return filters.gate_experience(pairs, v("roles")).select("doc_id", "role_id", "gate_reason")


@query("select_for_run", """
  SELECT DISTINCT e.role_id, e.version_id AS doc_id
  FROM evals e JOIN versions v ON v.version_id = e.version_id
  JOIN candidates c ON c.candidate_id = e.candidate_id JOIN roles r ON r.role_id = e.role_id
  WHERE v.is_current AND NOT c.deleted
    AND (c.years_experience IS NULL OR c.years_experience >= r.min_experience)
    AND (r.allowed_levels IS NULL OR c.level IN ('junior', 'mid', 'senior'))
    AND e.eval_status IS NOT NULL""")
def _(v):
    pairs = _board(v).withColumnRenamed("version_id", "doc_id")
    done = v("evals").withColumnRenamed("version_id", "doc_id")
    return filters.select_for_run(pairs, v("roles"), done)


@query("search_fields", """SELECT candidate_id, name, email, title FROM candidates
  WHERE (contains(lower(name), '007') OR contains(lower(email), '007'))
    AND level = 'senior' ORDER BY candidate_id LIMIT 20""")
def _(v):
    return filters.search_fields(
        v("candidates"), " 007 ", ["name", "email"], {"level": "senior"}, [F.col("candidate_id")]
    ).select("candidate_id", "name", "email", "title")


@query("search_text", """WITH hit AS (
    SELECT doc_id, text, total_score, strpos(lower(text), 'shtion') AS at_pos, length(text) AS size
    FROM documents JOIN scored_docs ON candidate_id = doc_id WHERE contains(lower(text), 'shtion')),
  top AS (SELECT * FROM hit ORDER BY total_score DESC, doc_id LIMIT 20)
  SELECT doc_id, total_score,
    CASE WHEN at_pos - 81 > 0 THEN '…' ELSE '' END ||
    regexp_replace(substr(text, CAST(greatest(0, at_pos - 81) + 1 AS INT),
      CAST(least(size, at_pos - 1 + 6 + 120) - greatest(0, at_pos - 81) AS INT)), '^\\s+|\\s+$', '', 'g') ||
    CASE WHEN least(size, at_pos - 1 + 6 + 120) < size THEN '…' ELSE '' END AS snippet FROM top""")
def _(v):
    docs = v("documents").select("doc_id", "text")
    scores = v("scored_docs").withColumnRenamed("candidate_id", "doc_id")
    return filters.search_text(docs, scores, "shtion")


@query("derive_status", f"""WITH {BOARD}, {LAST} SELECT b.evaluation_id, {STATUS} AS status
  FROM board b LEFT JOIN last_log l ON l.evaluation_id = b.evaluation_id""")
def _(v):
    return _board_with_status(v).select("evaluation_id", "status")


@query("filter_by_status", f"""WITH {BOARD}, {LAST}
  SELECT 'pending' AS wanted, evaluation_id FROM board
    WHERE evaluation_id NOT IN (SELECT evaluation_id FROM status_log)
  UNION ALL SELECT 'rejected', b.evaluation_id FROM board b LEFT JOIN last_log l USING (evaluation_id)
    WHERE latest_status = 'rejected' OR stage = 'rejected' OR eval_status IN ('tfidf_filtered', 'experience_filtered')
  UNION ALL SELECT 'review', b.evaluation_id FROM board b LEFT JOIN last_log l USING (evaluation_id)
    WHERE latest_status = 'review' OR needs_review
  UNION ALL SELECT 'shortlisted', b.evaluation_id FROM board b JOIN last_log l USING (evaluation_id)
    WHERE latest_status = 'shortlisted'""")
def _(v):
    rows, log = _board(v), v("status_log")
    out = None
    for wanted in ("pending", "rejected", "review", "shortlisted"):
        part = filters.filter_by_status(rows, log, wanted).select(F.lit(wanted).alias("wanted"), "evaluation_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("range_filters", f"""WITH {BOARD}, {LAST} SELECT evaluation_id, total_score, graduation_year FROM (
    SELECT b.*, {STATUS} AS status, {FILTER_STAGE} AS filter_stage
    FROM board b LEFT JOIN last_log l USING (evaluation_id))
  WHERE total_score >= 40 AND total_score <= 90 AND graduation_year BETWEEN 1993 AND 2000
    AND (status = 'review' OR (needs_review AND (status IS NULL OR status IN ('done', 'pending')))
         OR (status = 'pending' AND filter_stage = 'llm_scored'))
    AND coalesce(level, 'entry') = 'senior'""")
def _(v):
    return filters.range_filters(
        _board_with_status(v), 40, 90, 1993, 2000, "review", "senior"
    ).select("evaluation_id", "total_score", "graduation_year")


@query("review_buckets", f"""WITH {BOARD}, {LAST}, labelled AS (
    SELECT b.*, {STATUS} AS status, {FILTER_STAGE} AS filter_stage,
      r.require_github AND github_url IS NULL AS no_github, r.min_graduation_year AS lo, r.max_graduation_year AS hi,
      total_score / 400 AS tfidf_score
    FROM board b LEFT JOIN last_log l USING (evaluation_id) JOIN roles r ON r.role_id = b.role_id)
  SELECT evaluation_id, 'missing_github' AS bucket FROM labelled WHERE no_github
  UNION ALL SELECT evaluation_id, 'borderline_score' FROM labelled
    WHERE total_score >= 55 AND total_score < 65 AND NOT no_github
  UNION ALL SELECT evaluation_id, 'grad_year' FROM labelled WHERE graduation_year < lo OR graduation_year > hi
  UNION ALL SELECT evaluation_id, 'experience_mismatch' FROM labelled WHERE filter_stage = 'experience_filtered'
  UNION ALL SELECT evaluation_id, 'low_tfidf' FROM labelled WHERE tfidf_score BETWEEN 0.08 AND 0.15
  UNION ALL SELECT evaluation_id, 'manual_flag' FROM labelled WHERE status = 'review' AND NOT no_github
    AND NOT (total_score >= 55 AND total_score < 65) AND filter_stage = 'llm_scored'""")
def _(v):
    return filters.review_buckets(_bucket_rows(v))


def _bucket_rows(v):
    roles = v("roles").select("role_id", "require_github", "min_graduation_year", "max_graduation_year")
    c = F.col
    return _board_with_status(v).join(roles, "role_id").withColumn(
        "missed_requirement", labels.missed_requirement(c("require_github"), c("github_url"))
    ).withColumn("tfidf_score", c("total_score") / 400)


@query("band_labels", """SELECT evaluation_id,
    CASE WHEN project_score >= 80 THEN 'High' WHEN project_score >= 50 THEN 'Med' ELSE 'Low' END AS project_match_label,
    CASE WHEN skill_score / 60 >= 1.0 THEN 'high' WHEN skill_score / 60 >= 0.75 THEN 'medium' ELSE 'low' END AS confidence_label,
    CASE WHEN total_score >= 75 THEN 'strong' WHEN total_score >= 50 THEN 'moderate' ELSE 'weak' END AS fit_label
  FROM evals""")
def _(v):
    c = F.col
    return v("evals").select(
        "evaluation_id", *labels.band_labels(c("project_score"), c("skill_score") / 60, c("total_score")))


@query("skill_list_by_section", """SELECT doc_id, name AS skill,
    CASE WHEN section IN ('projects', 'experience', 'work_experience') THEN 'projects'
      WHEN section IN ('skills_section', 'skills', 'certifications') THEN 'skills'
      WHEN section = 'education' THEN 'education' ELSE 'other' END AS found_in FROM judgements""")
def _(v):
    rows = v("judgements").select("doc_id", F.col("name").alias("skill"), F.col("section").alias("best_section"))
    return filters.skill_list_by_section(rows).select("doc_id", "skill", "found_in")


@query("subject_filter", """SELECT conv_id, turn,
    CASE WHEN contains(lower(subject), 'shtion') OR contains(lower(subject), 'ament')
      OR contains(lower(subject), 'heit') THEN 'new' ELSE 'keyword_filtered' END AS route FROM mail""")
def _(v):
    return filters.subject_filter(v("mail"), "subject", ["Shtion", "ament", "heit"]).select("conv_id", "turn", "route")


@query("date_range_tz", """SELECT event_id, ts FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 330 MINUTE
    AND TIMESTAMP '2024-01-09 23:59:59' - INTERVAL 330 MINUTE""")
def _(v):
    return filters.date_range_tz(v("events"), "ts", "2024-01-05", "2024-01-09", -330).select("event_id", "ts")


@query("validate_roles", """SELECT role_id, 'weights must sum to 100' AS violation FROM roles
  WHERE weight_projects + weight_skills + weight_education <> 100
  UNION ALL SELECT role_id, 'requirement weights must sum to 100' FROM (
    SELECT role_id, sum(CASE WHEN is_required THEN 8.0 ELSE 7.0 END) AS t FROM role_skills GROUP BY role_id)
  WHERE abs(t - 100.0) > 0.5""")
def _(v):
    rules = v("role_skills").select(
        "role_id", F.when(F.col("is_required"), 8.0).otherwise(7.0).alias("weight"), F.lit("skill").alias("req_type"))
    return filters.validate_roles(v("roles"), rules)


@query("clean_sections", """SELECT conv_id, turn, CASE WHEN role IN ('user', 'system') THEN role ELSE 'unknown' END AS type
  FROM conversations""")
def _(v):
    return filters.clean_sections(
        v("conversations").select("conv_id", "turn", F.col("role").alias("type")), ["user", "system"])


@query("anti_deleted", """SELECT evaluation_id, candidate_id FROM evals e
  WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.candidate_id = e.candidate_id AND c.deleted)
    AND NOT EXISTS (SELECT 1 FROM status_log s WHERE s.evaluation_id = e.evaluation_id)""")
def _(v):
    kept = joins.anti_deleted(v("evals"), v("candidates").filter("deleted"), "candidate_id")
    return joins.anti_deleted(kept, v("status_log"), "evaluation_id").select("evaluation_id", "candidate_id")


@query("semi_match", """SELECT evaluation_id FROM evals
  WHERE evaluation_id IN (SELECT evaluation_id FROM status_log WHERE status = 'shortlisted')""")
def _(v):
    ids = v("status_log").filter("status = 'shortlisted'")
    return joins.semi_match(v("evals").select("evaluation_id"), ids, "evaluation_id")


@query("lookup_titles", """SELECT c_custkey, n_name, r_name FROM customer
  LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def _(v):
    people = v("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    named = joins.lookup_titles(people, v("nation"), "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return joins.lookup_titles(named, v("region"), "r_regionkey").select("c_custkey", "n_name", "r_name")


@query("skill_gaps", """SELECT e.evaluation_id, e.role_id, s.skill FROM evals e JOIN role_skills s ON s.role_id = e.role_id
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.evaluation_id = e.evaluation_id AND lower(m.skill) = lower(s.skill))""")
def _(v):
    return joins.skill_gaps(v("evals"), v("role_skills"), v("matches"))


INCOMING = """incoming AS (SELECT c_custkey AS incoming_id,
    CASE WHEN c_custkey % 4 = 0 THEN upper(email) WHEN c_custkey % 4 = 1 THEN 'relay@example.net' END AS sender_email,
    CASE WHEN c_custkey % 4 = 1 THEN email END AS doc_email,
    CASE WHEN c_custkey % 4 = 3 THEN 'Nobody Known' ELSE '  ' || upper(name) || ' ' END AS name
  FROM customer JOIN candidates ON candidate_id = c_custkey)"""


@query("resolve_entities", f"""WITH {INCOMING}, hit AS (
    SELECT i.incoming_id,
      (SELECT min(candidate_id) FROM candidates c WHERE lower(c.email) = lower(i.sender_email)) AS s,
      (SELECT min(candidate_id) FROM candidates c WHERE lower(c.email) = lower(i.doc_email)) AS d,
      (SELECT min(candidate_id) FROM candidates c WHERE NOT c.deleted AND lower(trim(c.name)) = lower(trim(i.name))) AS n
    FROM incoming i)
  SELECT incoming_id, coalesce(s, d, n) AS candidate_id, CASE WHEN s IS NOT NULL THEN 'sender_email'
    WHEN d IS NOT NULL THEN 'document_email' WHEN n IS NOT NULL THEN 'name' ELSE 'new' END AS matched_by FROM hit""")
def _(v):
    incoming = v.sql(INCOMING.split("AS (", 1)[1][:-1])
    return joins.resolve_entities(incoming, v("candidates"))


RESOLVED = f"""{INCOMING}, resolved AS (SELECT i.*,
      (SELECT min(candidate_id) FROM candidates c WHERE lower(c.email) = lower(i.sender_email)) AS by_sender,
      (SELECT min(candidate_id) FROM candidates c WHERE lower(c.email) = lower(i.doc_email)) AS by_doc,
      (SELECT min(candidate_id) FROM candidates c WHERE NOT c.deleted AND lower(trim(c.name)) = lower(trim(i.name))) AS by_name FROM incoming i)"""


@query("reactivated", f"""WITH {RESOLVED} SELECT candidate_id, name, email FROM candidates
  WHERE deleted AND candidate_id IN (SELECT coalesce(by_sender, by_doc) FROM resolved)""")
def _(v):
    incoming = v.sql(INCOMING.split("AS (", 1)[1][:-1])
    found = joins.reactivated(joins.resolve_entities(incoming, v("candidates")), v("candidates"))
    return found.select("candidate_id", "name", "email")


@query("assign_new_ids", f"""WITH {RESOLVED}, fresh AS (SELECT incoming_id, coalesce(nullif(lower(sender_email), ''), nullif(lower(doc_email), ''), lower(trim(name))) AS person_key
    FROM resolved WHERE by_sender IS NULL AND by_doc IS NULL AND by_name IS NULL)
  SELECT incoming_id, person_key, 1000000 + dense_rank() OVER (ORDER BY person_key) - 1 AS candidate_id FROM fresh""")
def _(v):
    incoming = v.sql(INCOMING.split("AS (", 1)[1][:-1])
    resolved = joins.resolve_entities(incoming, v("candidates"))
    return joins.assign_new_ids(resolved, incoming, 1_000_000).select("incoming_id", "person_key", "candidate_id")


# Every tenth owner has an entry without company and end month, too.
LEFT_SIDE = """left_side AS (SELECT owner, company, end_month FROM companies_left
    UNION ALL SELECT DISTINCT owner, CAST(NULL AS VARCHAR(99)), CAST(NULL AS VARCHAR(99)) FROM companies_left WHERE owner % 10 = 0)"""


def _reconciled(v):
    return joins.reconcile_sources(v.sql(f"SELECT * FROM ({LEFT_SIDE.split('AS (', 1)[1][:-1]})"), v("companies_right"))


@query("reconcile_sources", f"""WITH {LEFT_SIDE}, both_sides AS (
    SELECT coalesce(a.owner, b.owner) AS owner, a.owner IS NOT NULL AS l, a.company AS l_name, a.end_month AS l_end, b.company AS r_name, b.end_month AS r_end,
      abs((CAST(substr(a.end_month, 1, 4) AS INT) * 12 + CAST(substr(a.end_month, 6, 2) AS INT))
        - (CAST(substr(b.end_month, 1, 4) AS INT) * 12 + CAST(substr(b.end_month, 6, 2) AS INT))) AS gap
    FROM left_side a FULL JOIN companies_right b ON a.owner = b.owner AND lower(a.company) = lower(b.company))
  SELECT owner, 'experience.' || l_name || '.end_date' AS field, l_end AS left_value, r_end AS right_value, 'date_mismatch' AS flag_type
    FROM both_sides WHERE gap > 3
  UNION ALL SELECT owner, 'experience.' || coalesce(l_name, ''), l_name, NULL, 'missing_entry' FROM both_sides WHERE r_name IS NULL
  UNION ALL SELECT owner, 'experience.' || r_name, NULL, r_name, 'missing_entry' FROM both_sides WHERE NOT l""")
def _(v):
    return _reconciled(v)[1]


@query("reconcile_merged", f"""WITH {LEFT_SIDE} SELECT a.owner, a.company, a.end_month, b.company IS NOT NULL AS validated, b.company AS other_name
  FROM left_side a LEFT JOIN companies_right b ON a.owner = b.owner AND lower(a.company) = lower(b.company)""")
def _(v):
    return _reconciled(v)[0]


@query("calibration_join", """SELECT s.candidate_id, total_score, outcome FROM scored_docs s
  JOIN outcomes o ON o.candidate_id = s.candidate_id""")
def _(v):
    return joins.calibration_join(v("scored_docs"), v("outcomes"))


@query("latest_status", f"""WITH {LAST} SELECT evaluation_id, latest_status, (SELECT max(changed_at) FROM status_log s
    WHERE s.evaluation_id = l.evaluation_id) AS latest_changed_at FROM last_log l""")
def _(v):
    return windows.latest_status(v("status_log"))


@query("latest_role_per_owner", """SELECT candidate_id, evaluation_id, role_id FROM (
    SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY evaluated_at DESC, evaluation_id DESC) AS rn FROM evals)
  WHERE rn = 1""")
def _(v):
    return windows.latest_role_per_owner(v("evals"))


@query("current_version", """SELECT version_id, candidate_id, row_number() OVER (
    PARTITION BY candidate_id ORDER BY uploaded_at DESC, version_id DESC) = 1 AS is_current FROM versions""")
def _(v):
    return windows.current_version(v("versions")).select("version_id", "candidate_id", "is_current")


@query("global_rank", """SELECT evaluation_id, row_number() OVER (ORDER BY
    CASE level WHEN 'executive' THEN 1 WHEN 'senior' THEN 2 WHEN 'mid' THEN 3 WHEN 'junior' THEN 4 ELSE 5 END,
    total_score DESC, evaluation_id) AS rank
  FROM evals e JOIN candidates c ON c.candidate_id = e.candidate_id""")
def _(v):
    rows = v("evals").select("evaluation_id", "candidate_id", "total_score").join(
        v("candidates").select("candidate_id", "level"), "candidate_id")
    return windows.global_rank(
        rows, [F.desc("total_score"), F.col("evaluation_id")], "level").select("evaluation_id", "rank")


@query("experience_years", """WITH o AS (SELECT *, max(end_year) OVER (PARTITION BY owner ORDER BY start_year, end_year, range_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM profile_ranges),
    islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_year > reach THEN 1 ELSE 0 END) OVER (
      PARTITION BY owner ORDER BY start_year, end_year, range_id) AS island FROM o),
    spans AS (SELECT owner, island, max(end_year) - min(start_year) AS len FROM islands GROUP BY owner, island)
  SELECT owner, CAST(sum(len) AS DOUBLE) AS years FROM spans GROUP BY owner""")
def _(v):
    return windows.experience_years(v("profile_ranges"))


@query("burst_window", """WITH at_stamp AS (SELECT user_id, ts, count(*) AS at_stamp FROM events GROUP BY user_id, ts)
  SELECT user_id, ts, at_stamp, CAST(sum(at_stamp) OVER w AS BIGINT) AS in_window, sum(at_stamp) OVER w > 3 AS over_limit
  FROM at_stamp WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def _(v):
    return windows.burst_window(v("events"), "user_id", "ts", 86400, 3)


@query("sort_page", f"""WITH {BOARD} SELECT evaluation_id, skill_score FROM board WHERE {ACTIVE}
  ORDER BY skill_score, evaluation_id LIMIT 25 OFFSET 50""")
def _(v):
    return topk.sort_page(filters.active_current(_board(v)), "skill_score", "asc", 3, 25).select(
        "evaluation_id", "skill_score")


@query("page_count", f"""WITH {BOARD} SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages
  FROM board WHERE {ACTIVE}""")
def _(v):
    return topk.page_count(filters.active_current(_board(v)), 25)


@query("deep_page", """SELECT evaluation_id, total_score FROM evals ORDER BY total_score DESC, evaluation_id LIMIT 20 OFFSET (SELECT (count(*) // 40) * 20 FROM evals)""")
def _(v):
    """The page in the middle of the board, sought with few rows sorted."""
    rows = v("evals").select("evaluation_id", "total_score")
    page = rows.agg(F.count(F.lit(1))).first()[0] // 40 + 1
    return topk.sort_page(rows, page=page, limit=20, most=200)


@query("client_sort", """SELECT candidate_id, name, years_experience FROM candidates
  ORDER BY coalesce(years_experience, 0) DESC, candidate_id""")
def _(v):
    return topk.client_sort(v("candidates"), "years_experience").select("candidate_id", "name", "years_experience")


@query("top_projects", """SELECT owner, repo_id, hits, stars FROM (
    SELECT *, row_number() OVER (PARTITION BY owner ORDER BY hits DESC, stars DESC, repo_id) AS rn FROM (
      SELECT r.*, (SELECT count(*) FROM role_skills s WHERE s.skill = r.name AND s.role_id <= 2) AS hits FROM repos r))
  WHERE rn <= 8""")
def _(v):
    wanted = v("role_skills").filter("role_id <= 2").groupBy(F.col("skill").alias("name")).agg(
        F.count(F.lit(1)).alias("hits"))
    repos = v("repos").join(wanted, "name", "left").na.fill(0, ["hits"])
    return topk.top_projects(repos).select("owner", "repo_id", "hits", "stars")


@query("top_excerpt", """SELECT doc_id, name AS top_excerpt FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS rn FROM judgements
    WHERE score >= 55) WHERE rn = 1""")
def _(v):
    rows = v("judgements").filter("score >= 55").join(
        v("skills").select(F.col("skill").alias("name")), "name")
    order = v.sql("SELECT skill AS name, row_number() OVER (ORDER BY skill) AS position FROM skills")
    return topk.top_excerpt(rows.join(order, "name").withColumn("excerpt", F.col("name")), ["doc_id"])


@query("strengths_gaps", """WITH m AS (SELECT evaluation_id, skill, row_number() OVER (PARTITION BY evaluation_id ORDER BY skill) AS rn FROM matches),
    g AS (SELECT e.evaluation_id, s.skill, row_number() OVER (PARTITION BY e.evaluation_id ORDER BY s.skill) AS rn
      FROM evals e JOIN role_skills s ON s.role_id = e.role_id
      WHERE NOT EXISTS (SELECT 1 FROM matches x WHERE x.evaluation_id = e.evaluation_id AND x.skill = s.skill)),
    ms AS (SELECT evaluation_id, string_agg(skill, ', ' ORDER BY skill) AS strengths FROM m WHERE rn <= 5 GROUP BY 1),
    gs AS (SELECT evaluation_id, string_agg(skill, ', ' ORDER BY skill) AS gaps FROM g WHERE rn <= 3 GROUP BY 1)
  SELECT coalesce(ms.evaluation_id, gs.evaluation_id) AS evaluation_id, strengths, gaps FROM ms FULL JOIN gs USING (evaluation_id)""")
def _(v):
    gaps = joins.skill_gaps(v("evals"), v("role_skills"), v("matches"))
    return topk.strengths_gaps(
        v("matches").withColumn("position", F.lit(0)), gaps.withColumn("position", F.lit(0)))


@query("weakest_strongest", """SELECT doc_id, CASE WHEN w.score < 40 THEN w.name END AS weakest,
    CASE WHEN s.score >= 80 AND s.name <> w.name THEN s.name END AS strongest
  FROM (SELECT doc_id, name, score, row_number() OVER (PARTITION BY doc_id ORDER BY score, name) AS rn FROM judgements) w
  JOIN (SELECT doc_id, name, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name DESC) AS rn FROM judgements) s
    USING (doc_id) WHERE w.rn = 1 AND s.rn = 1""")
def _(v):
    rows = v("judgements").select("doc_id", F.col("name").alias("label"), "score", F.col("name").alias("position"))
    return topk.weakest_strongest(rows, "doc_id")


@query("compare_pair", """WITH pairs AS (SELECT evaluation_id AS a, lead(evaluation_id) OVER (
      PARTITION BY candidate_id ORDER BY evaluation_id) AS b FROM evals),
    p AS (SELECT * FROM pairs WHERE b IS NOT NULL),
    ma AS (SELECT a, b, skill FROM p JOIN matches ON evaluation_id = a),
    mb AS (SELECT a, b, skill FROM p JOIN matches ON evaluation_id = b),
    g AS (SELECT e.evaluation_id, count(*) AS n FROM evals e JOIN role_skills s ON s.role_id = e.role_id
      WHERE NOT EXISTS (SELECT 1 FROM matches x WHERE x.evaluation_id = e.evaluation_id AND x.skill = s.skill) GROUP BY 1),
    sets AS (SELECT a, b, count_if(in_a AND in_b) AS both_n, count_if(in_a AND NOT in_b) AS a_n, count_if(NOT in_a AND in_b) AS b_n
      FROM (SELECT coalesce(ma.a, mb.a) AS a, coalesce(ma.b, mb.b) AS b, ma.skill IS NOT NULL AS in_a, mb.skill IS NOT NULL AS in_b
        FROM ma FULL JOIN mb ON ma.a = mb.a AND ma.b = mb.b AND ma.skill = mb.skill) GROUP BY a, b)
  SELECT p.a, p.b, CAST(coalesce(both_n, 0) AS BIGINT) AS shared_count, CAST(coalesce(a_n, 0) AS BIGINT) AS only_a_count,
    CAST(coalesce(b_n, 0) AS BIGINT) AS only_b_count, coalesce(ga.n, 0) AS gaps_a, coalesce(gb.n, 0) AS gaps_b,
    CASE WHEN ea.total_score >= eb.total_score THEN p.a ELSE p.b END AS best_pick,
    round_even(abs(ea.total_score - eb.total_score), 1) AS score_diff
  FROM p JOIN evals ea ON ea.evaluation_id = p.a JOIN evals eb ON eb.evaluation_id = p.b
  LEFT JOIN sets ON sets.a = p.a AND sets.b = p.b LEFT JOIN g ga ON ga.evaluation_id = p.a LEFT JOIN g gb ON gb.evaluation_id = p.b""")
def _(v):
    pairs = v.sql("""SELECT * FROM (SELECT evaluation_id AS a, lead(evaluation_id) OVER (
        PARTITION BY candidate_id ORDER BY evaluation_id) AS b FROM evals) WHERE b IS NOT NULL""")
    gaps = joins.skill_gaps(v("evals"), v("role_skills"), v("matches"))
    return sets.compare_pairs(pairs, v("evals"), v("matches"), gaps)


@query("dedup_keep_first", """SELECT source, token, pos FROM (
    SELECT source, token, pos, row_number() OVER (PARTITION BY source, lower(token) ORDER BY pos, token) AS rn FROM (
      SELECT source, doc_id * 1000 AS pos, unnest(string_split_regex(text, '\\s+')) AS token FROM documents))
  WHERE rn = 1""")
def _(v):
    words = v("documents").select(
        "source", (F.col("doc_id") * 1000).alias("pos"), F.explode(F.split("text", r"\s+")).alias("token"))
    return sets.dedup_keep_first(words, ["source"], "token", "pos")


@query("skill_tokens", """SELECT p_partkey, array_to_string(list_transform(list_filter(
    string_split_regex(lower(p_name || '-' || p_type || '/C++'), '[\\s\\-_./]+'), lambda p: length(p) >= 3),
    lambda p: regexp_replace(p, '[^a-z0-9]', '', 'g')), ',') AS tokens FROM part""")
def _(v):
    name = F.concat_ws("", "p_name", F.lit("-"), "p_type", F.lit("/C++"))
    return v("part").select("p_partkey", F.array_join(sets.skill_tokens(name), ",").alias("tokens"))


@query("vocab_union", """WITH terms AS (SELECT owner, language AS term FROM repos UNION ALL SELECT owner, name FROM repos)
  SELECT DISTINCT owner, token FROM (SELECT owner, regexp_replace(t, '[^a-z0-9]', '', 'g') AS token FROM (
    SELECT owner, unnest(string_split_regex(lower(term), '[\\s\\-_./]+')) AS t FROM terms) WHERE length(t) >= 3)
  WHERE token <> ''""")
def _(v):
    repos = v("repos")
    return sets.vocab_union([repos.select("owner", F.col(c).alias("term")) for c in ("language", "name")])
