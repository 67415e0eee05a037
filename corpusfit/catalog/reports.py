"""Counts, averages, funnels, calibration and project evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfit.catalog.documents import SECTIONS
from corpusfit.catalog.registry import query
from corpusfit.catalog.relational import BOARD, LAST, _board
from corpusfit.operators import aggs, joins, projects, sets
from corpusfit.operators.flags import project_names
from corpusfit.plans.segment import segment

BINS = "bins AS (SELECT unnest(range(10)) AS bin)"


@query("score_histogram", f"""WITH {BINS}, n AS (SELECT least(floor(total_score / 10), 9) AS bin, count(*) AS n FROM evals GROUP BY 1)
  SELECT (b.bin * 10) || '-' || (b.bin * 10 + 10) AS range, coalesce(n.n, 0) AS count FROM bins b LEFT JOIN n ON n.bin = b.bin""")
def _(v):
    return aggs.score_histogram(v("evals"))


@query("overall_averages", f"""WITH {BOARD} SELECT count(*) AS total_evaluated, round_even(avg(total_score), 1) AS avg_score,
    round_even(avg(project_score), 1) AS avg_projects, round_even(avg(skill_score), 1) AS avg_skills,
    round_even(avg(education_score), 1) AS avg_education, CAST(count_if(needs_review) AS BIGINT) AS needs_review_count
  FROM board WHERE eval_status IS NULL""")
def _(v):
    return aggs.overall_averages(_board(v).filter("eval_status is null"))


@query("status_counts", f"""WITH {LAST} SELECT coalesce(latest_status, 'none') AS status, count(*) AS count
  FROM evals LEFT JOIN last_log USING (evaluation_id) GROUP BY 1""")
def _(v):
    return aggs.status_counts(v("evals"), v("status_log"))


RATES = """rates AS (SELECT s.role_id, s.skill, coalesce(h.n, 0) AS matched_count, t.n AS total,
    round_even(coalesce(h.n, 0) / t.n * 100, 1) AS match_rate
  FROM role_skills s JOIN (SELECT role_id, count(*) AS n FROM evals GROUP BY role_id) t ON t.role_id = s.role_id
  LEFT JOIN (SELECT role_id, skill, count(*) AS n FROM evals JOIN matches USING (evaluation_id) GROUP BY role_id, skill) h
    ON h.role_id = s.role_id AND h.skill = s.skill)"""


@query("skill_match_rates", f"WITH {RATES} SELECT * FROM rates")
def _(v):
    return aggs.skill_match_rates(v("evals"), v("matches"), v("role_skills"))


@query("skill_match_top", """SELECT skill, count(*) AS matched_count, (SELECT count(*) FROM evals) AS total,
    round_even(count(*) / (SELECT count(*) FROM evals) * 100, 1) AS match_rate
  FROM matches JOIN evals USING (evaluation_id) GROUP BY skill ORDER BY matched_count DESC, skill LIMIT 20""")
def _(v):
    return aggs.skill_match_rates(v("evals"), v("matches"))


@query("top_skill_gaps", f"""WITH {RATES} SELECT * FROM rates WHERE match_rate < 50 ORDER BY match_rate, skill, role_id LIMIT 10""")
def _(v):
    return aggs.top_skill_gaps(aggs.skill_match_rates(v("evals"), v("matches"), v("role_skills")))


@query("daily_counts", """WITH days AS (SELECT DATE '2024-01-31' - CAST(unnest(range(14)) AS INT) AS day)
  SELECT strftime(day, '%Y-%m-%d') AS date, count(event_id) AS count FROM days LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY day""")
def _(v):
    return aggs.daily_counts(v("events"), "ts", 14, "2024-01-31")


@query("stage_funnel", f"""WITH {BOARD}, stages AS (SELECT * FROM (VALUES (1, 'applied', 'Applied'), (2, 'screening', 'Screening'),
    (3, 'coding', 'Coding Test'), (4, 'interview', 'Interview'), (5, 'offer', 'Offer'), (6, 'hired', 'Hired'),
    (7, 'rejected', 'Rejected')) AS t(position, stage, label))
  SELECT position, s.stage, label, count(b.evaluation_id) AS count FROM stages s LEFT JOIN board b ON b.stage = s.stage GROUP BY ALL""")
def _(v):
    return aggs.stage_funnel(_board(v))


@query("level_stats", """SELECT coalesce(level, 'unknown') AS level, count(*) AS count, round_even(avg(total_score), 1) AS avg_score
  FROM evals e JOIN candidates c ON c.candidate_id = e.candidate_id GROUP BY 1""")
def _(v):
    return aggs.level_stats(_board(v))


CALIBRATION = f"""WITH {BINS}, j AS (SELECT total_score, outcome, least(floor(total_score / 10), 9) AS bin FROM scored_docs s
    JOIN outcomes o ON o.candidate_id = s.candidate_id),
  cal AS (SELECT b.bin, count(j.bin) AS total, CAST(count_if(outcome = 'hired') AS BIGINT) AS hired,
    CAST(count_if(outcome IN ('rejected', 'withdrew', 'ghosted', 'declined')) AS BIGINT) AS rejected
    FROM bins b LEFT JOIN j ON j.bin = b.bin GROUP BY b.bin),
  above AS (SELECT bin, sum(total) OVER w AS n, sum(hired) OVER w AS h, sum(hired) OVER () AS all_h
    FROM cal WINDOW w AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
  pr AS (SELECT bin, n, h / n AS p, CASE WHEN all_h > 0 THEN h / all_h ELSE 0 END AS r FROM above WHERE bin >= 1 AND n > 0),
  curve AS (SELECT CAST(bin * 10 AS DOUBLE) AS threshold, round_even(p * 100, 1) AS precision, round_even(r * 100, 1) AS recall,
    round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * 100, 1) AS f1, CAST(n AS BIGINT) AS candidates_above FROM pr)"""


def _calibration(v):
    return aggs.calibration_buckets(joins.calibration_join(v("scored_docs"), v("outcomes")))


@query("calibration_buckets", CALIBRATION + """ SELECT bin, (bin * 10) || '-' || (bin * 10 + 10) AS range, total, hired, rejected,
    CASE WHEN total > 0 THEN round_even(hired / total * 100, 1) ELSE 0.0 END AS hire_rate FROM cal""")
def _(v):
    return _calibration(v)


@query("threshold_curve", CALIBRATION + " SELECT * FROM curve")
def _(v):
    return aggs.threshold_curve(_calibration(v))


@query("suggest_threshold", CALIBRATION + """ SELECT threshold AS suggested_threshold FROM curve WHERE candidates_above >= 2
  ORDER BY f1 DESC, threshold LIMIT 1""")
def _(v):
    return aggs.suggest_threshold(aggs.threshold_curve(_calibration(v)))


@query("summary_counts", f"""WITH {BOARD}, {LAST}, f AS (SELECT b.*, latest_status,
      eval_status IN ('tfidf_filtered', 'experience_filtered') IS TRUE AS filtered,
      NOT deleted AND is_current AND (eval_status IS NULL OR eval_status IN ('tfidf_filtered', 'experience_filtered')) AS shown
    FROM board b LEFT JOIN last_log USING (evaluation_id))
  SELECT count(*) FILTER (shown) AS total, round_even(avg(total_score) FILTER (shown), 1) AS avg_score,
    count(*) FILTER (shown AND latest_status = 'shortlisted') AS shortlisted, count(*) FILTER (shown AND needs_review) AS needs_review,
    count(*) FILTER (shown AND latest_status IS NULL AND NOT needs_review AND NOT filtered) AS pending,
    count(*) FILTER (shown AND eval_status = 'tfidf_filtered') AS tfidf_filtered,
    count(*) FILTER (shown AND eval_status = 'experience_filtered') AS experience_filtered,
    count(*) FILTER (NOT deleted AND eval_status = 'queued') AS queued FROM f""")
def _(v):
    return aggs.summary_counts(_board(v), v("status_log"))


@query("run_progress", """SELECT role_id, count(*) AS total, count(*) FILTER (eval_status IS NULL) AS scored,
    count(*) FILTER (eval_status = 'queued') AS queued, count(*) FILTER (eval_status = 'processing') AS processing,
    count(*) FILTER (eval_status LIKE '%filtered') AS filtered, count(*) FILTER (eval_status = 'error') AS error,
    count(*) FILTER (eval_status IN ('queued', 'processing')) > 0 AS in_progress FROM evals GROUP BY role_id""")
def _(v):
    return aggs.run_progress(v("evals"))


@query("intake_stats", "SELECT count(*) AS total, " + ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}" for s in
    ("processed", "failed", "new", "no_attachment", "keyword_filtered")) + " FROM landing")
def _(v):
    return aggs.intake_stats(v("landing"))


@query("feedback_averages", """SELECT owner, count(*) AS responses, round_even(avg(rating), 1) AS avg_rating,
    round_even(avg(technical), 1) AS avg_technical, round_even(avg(communication), 1) AS avg_communication,
    round_even(avg(culture_fit), 1) AS avg_culture_fit FROM feedback GROUP BY owner""")
def _(v):
    return aggs.feedback_averages(v("feedback"))


@query("weighted_average", """SELECT l_suppkey, round_even(coalesce(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 0), 8) AS weighted
  FROM lineitem GROUP BY l_suppkey""")
def _(v):
    return v("lineitem").groupBy("l_suppkey").agg(
        F.bround(aggs.weighted_average(F.col("l_discount"), F.col("l_quantity")), 8).alias("weighted"))


ACTIVITY = """activity AS (SELECT owner, count(*) AS repos, CAST(round_even(least(count(*), 30) / 30 * 30
      + count(*) FILTER (date_diff('day', CAST(updated_at AS DATE), DATE '2002-01-01') / 30.44E0 < 12) / count(*) * 40
      + least(CAST(sum(stars) AS BIGINT), 50) / 50 * 30, 0) AS INT) AS activity_score FROM repos GROUP BY owner)"""


@query("activity_score", f"WITH {ACTIVITY} SELECT * FROM activity")
def _(v):
    return aggs.activity_score(v("repos"), "2002-01-01")


@query("language_ranking", "SELECT owner, language, count(*) AS repo_count FROM repos GROUP BY owner, language")
def _(v):
    return aggs.language_ranking(v("repos"))


@query("inferred_skills", """WITH known AS (SELECT DISTINCT o_custkey AS owner, lower(company) AS k FROM orders JOIN companies_left ON owner = o_custkey),
  n AS (SELECT owner, language, repo_id, name, row_number() OVER (PARTITION BY owner, language ORDER BY repo_id) AS rn FROM repos r
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.owner = r.owner AND k.k = lower(r.language)))
  SELECT owner, language, string_agg(name, ', ' ORDER BY repo_id) AS evidence FROM n GROUP BY owner, language""")
def _(v):
    known = v("companies_left").select("owner", F.col("company").alias("skill"))
    return aggs.inferred_skills(v("repos"), known)


MODIFIER_BODY = f"""{ACTIVITY},
    pn AS (SELECT doc_id AS owner, line AS project_name FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) AS line FROM sections WHERE type = 'projects')
      WHERE length(line) BETWEEN 4 AND 80 AND NOT regexp_matches(line, '^[•\\-*–]') AND NOT regexp_matches(line, '\\d{{4}}')),
    ow AS (SELECT DISTINCT doc_id AS owner, role_id FROM applications),
    relevant AS (SELECT o.owner, o.role_id, repo_id, name, list_sort(list(DISTINCT lower(skill))) AS matched FROM ow o JOIN repos r ON r.owner = o.owner
      JOIN role_skills k ON k.role_id = o.role_id AND (contains(lower(name) || ' ', lower(skill)) OR contains(lower(skill), lower(name) || ' ')) GROUP BY 1, 2, 3, 4),
    rel_words AS (SELECT DISTINCT owner, role_id, unnest(string_split(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), ' ')) AS w FROM relevant),
    named AS (SELECT o.owner, o.role_id, EXISTS (SELECT 1 FROM rel_words x WHERE x.owner = o.owner AND x.role_id = o.role_id AND w <> ''
        AND list_contains(string_split(regexp_replace(lower(project_name), '[^a-z0-9 ]', '', 'g'), ' '), w)) AS known FROM ow o JOIN pn ON pn.owner = o.owner),
    unverified AS (SELECT owner, role_id, count(*) AS projects, count(*) FILTER (NOT known) AS unverified FROM named GROUP BY 1, 2),
    n_rel AS (SELECT owner, role_id, count(*) AS relevant FROM relevant GROUP BY 1, 2),
    modifiers AS (SELECT o.owner, o.role_id, CAST(greatest(-10, least(10,
      CASE WHEN activity_score >= 70 THEN 4.0 WHEN activity_score >= 50 THEN 2.0 WHEN activity_score >= 30 THEN 1.0
        WHEN activity_score < 15 THEN -2.0 ELSE 0.0 END
      + CASE WHEN relevant >= 3 THEN 3.0 WHEN relevant >= 1 THEN 1.5 ELSE 0.0 END
      + CASE WHEN unverified >= 3 THEN -3.0 WHEN unverified = projects AND projects >= 2 THEN -2.0 ELSE 0.0 END)) AS DOUBLE) AS modifier
      FROM ow o JOIN activity a ON a.owner = o.owner LEFT JOIN n_rel x ON x.owner = o.owner AND x.role_id = o.role_id
      LEFT JOIN unverified u ON u.owner = o.owner AND u.role_id = o.role_id)"""
MODIFIER = SECTIONS.replace("SRC", "profile_docs") + ", " + MODIFIER_BODY


def _code_evidence(v):
    """Pairs, relevant repositories and counts of unverified projects."""
    pairs = v("applications").withColumnRenamed("doc_id", "owner")
    relevant = projects.relevant_repos(v("repos"), v("role_skills"), pairs)
    sections = v.keep("sections", lambda: segment(v("profile_docs")))
    names = project_names(sections).withColumnRenamed("doc_id", "owner")
    return pairs, relevant, projects.unverified_projects(names, relevant, pairs)


def modifiers(v):
    pairs, relevant, unverified = _code_evidence(v)
    return projects.score_modifiers(aggs.activity_score(v("repos"), "2002-01-01"), relevant, unverified, pairs)


@query("relevant_repos", f"WITH {MODIFIER} SELECT owner, role_id, repo_id, name, array_to_string(matched, ', ') AS matched_skills FROM relevant")
def _(v):
    return _code_evidence(v)[1].withColumn("matched_skills", F.array_join("matched_skills", ", "))


@query("unverified_projects", f"WITH {MODIFIER} SELECT owner, role_id, projects, unverified FROM unverified")
def _(v):
    return _code_evidence(v)[2]


@query("rescore_modifier", f"WITH {MODIFIER} SELECT owner, role_id, modifier FROM modifiers")
def _(v):
    return modifiers(v)


PROJECT = """WITH words AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9#+.]+'),
      lambda w: length(w) > 2 AND w NOT IN ('and', 'or', 'the', 'a', 'an', 'in', 'with', 'for', 'to', 'of', 'is', 'are'))) AS rule,
      lower(text) AS label FROM benchmark),
    docs AS (SELECT d.doc_id, role_id, lower(text) AS body, list_distinct(regexp_extract_all(lower(text), '[a-z0-9#+.]+')) AS seen
      FROM documents d JOIN doc_applications a ON a.doc_id = d.doc_id),
    rs AS (SELECT term_id % (SELECT count(*) FROM benchmark) AS role_id, term FROM dict_terms),
    found AS (SELECT d.doc_id, list_sort(list(term)) AS skills FROM docs d JOIN rs ON rs.role_id = d.role_id WHERE contains(body, term) GROUP BY d.doc_id),
    scored AS (SELECT d.doc_id AS project_id, d.role_id, coalesce(array_to_string(f.skills, ', '), '') AS matched_skills, coalesce(len(f.skills), 0) AS n_skills,
      CASE WHEN len(list_intersect(w.rule, d.seen)) >= 2 OR contains(d.body, w.label) THEN 1 ELSE 0 END AS rules_met
      FROM docs d JOIN words w ON w.item_id = d.role_id LEFT JOIN found f ON f.doc_id = d.doc_id)"""


def _project_match(v):
    work = v("documents").select(F.col("doc_id").alias("project_id"), "text").join(
        v("doc_applications").withColumnRenamed("doc_id", "project_id"), "project_id")
    rules = v("benchmark").select(
        F.col("item_id").alias("role_id"), F.col("text").alias("label"), F.lit("").alias("description"))
    wanted = v.sql("""SELECT term_id % (SELECT count(*) FROM benchmark) AS role_id, term AS skill FROM dict_terms""")
    return projects.project_match(work, wanted, rules), wanted


@query("project_match", PROJECT + """ SELECT project_id, role_id, matched_skills, CAST(rules_met AS BIGINT) AS rules_met,
    CAST(rules_met AS DOUBLE) AS match_score FROM scored""")
def _(v):
    return _project_match(v)[0].withColumn("matched_skills", F.array_join("matched_skills", ", "))


@query("project_overall", PROJECT + """, shown AS (SELECT source AS owner, d.role_id, count(DISTINCT rs.term) AS shown
    FROM docs d JOIN documents o ON o.doc_id = d.doc_id LEFT JOIN rs ON rs.role_id = d.role_id AND contains(d.body, rs.term) GROUP BY 1, 2)
  SELECT owner, s.role_id, CAST(round_even(shown / t.total * 100, 0) AS INT) AS overall_match, t.total - shown AS unmatched
  FROM shown s JOIN (SELECT role_id, count(*) AS total FROM rs GROUP BY role_id) t ON t.role_id = s.role_id""")
def _(v):
    scored, wanted = _project_match(v)
    owners = v("documents").select(F.col("doc_id").alias("project_id"), F.col("source").alias("owner"))
    return projects.project_overall(scored, owners, wanted)


CROSS = f"""WITH {ACTIVITY}, terms AS (SELECT owner, language AS term FROM repos UNION ALL SELECT owner, name FROM repos),
    vocab AS (SELECT DISTINCT owner, token FROM (SELECT owner, regexp_replace(t, '[^a-z0-9]', '', 'g') AS token FROM (
      SELECT owner, unnest(string_split_regex(lower(term), '[\\s\\-_./]+')) AS t FROM terms) WHERE length(t) >= 3) WHERE token <> ''),
    claims AS (SELECT DISTINCT doc_id AS owner, skill FROM applications JOIN role_skills USING (role_id)
      UNION SELECT doc_id, 'Agile ' || skill FROM applications JOIN role_skills USING (role_id) WHERE role_id = 1),
    forms AS (SELECT DISTINCT skill, list_filter(string_split_regex(lower(skill), '[\\s\\-_./]+'), lambda p: length(p) >= 3) AS parts FROM claims),
    judged AS (SELECT owner FROM activity WHERE activity_score > 20 AND owner IN (SELECT owner FROM vocab)),
    shown AS (SELECT DISTINCT c.owner, c.skill FROM claims c JOIN forms f ON f.skill = c.skill JOIN vocab v ON v.owner = c.owner
      WHERE list_contains(parts, token) OR contains(array_to_string(parts, ''), token) AND length(token) >= 3
        OR contains(token, array_to_string(parts, '')) AND length(token) >= 3),
    verdict AS (SELECT c.owner, c.skill, (c.owner NOT IN (SELECT owner FROM judged)) OR regexp_matches(c.skill, '(?i)\\bagile\\b')
      OR EXISTS (SELECT 1 FROM shown s WHERE s.owner = c.owner AND s.skill = c.skill) AS verified FROM claims c)"""


def _verified(v):
    repos = v("repos")
    evidence = sets.vocab_union([
        repos.select("owner", F.col("language").alias("term")),
        repos.select("owner", F.col("name").alias("term"))])
    # Pairs are dealt out by owner before they are multiplied by skills; the claims are made distinct and judged where they are made.
    pairs = v("applications").select(F.col("doc_id").alias("owner"), "role_id").repartition(v.tasks(), "owner")
    skill = F.col("skill")
    said = F.when(F.col("role_id") == 1, F.array(skill, F.concat(F.lit("Agile "), skill))).otherwise(F.array(skill))
    claims = pairs.join(v("role_skills").select("role_id", "skill"), "role_id").select("owner", F.explode(said).alias("skill"))
    return projects.cross_reference(claims, evidence, aggs.activity_score(repos, "2002-01-01"))


@query("cross_reference", CROSS + " SELECT owner, skill, verified FROM verdict")
def _(v):
    return _verified(v)


@query("skill_gap_severity", CROSS + """, n AS (SELECT owner, count(*) AS total, count(*) FILTER (NOT verified) AS unverified FROM verdict GROUP BY owner)
  SELECT *, CASE WHEN unverified >= 4 AND unverified / total >= 0.6 THEN 'high'
    WHEN unverified >= 3 OR unverified / total >= 0.5 THEN 'medium' END AS severity FROM n""")
def _(v):
    return projects.skill_gap_flags(_verified(v))
