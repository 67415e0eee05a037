"""Document-level queries: sources, near-duplicates, sections, terms and relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfit.catalog.registry import query
from corpusfit.catalog.relational import BOARD, LAST, _board
from corpusfit.functions import lists
from corpusfit.functions.text import page_headings
from corpusfit.operators import dictionary, flags, sets
from corpusfit.plans import dedup, segment, tfidf
from corpusfit.scale import by_shuffle, salted_join
from corpusfit.sources import readers, sinks
from corpusfit.streaming import run

C = F.col


@query("scan_documents", "SELECT doc_id, text, lang FROM documents WHERE text IS NOT NULL")
def _(v):
    return readers.scan_documents(v.spark, v.folder).select("doc_id", "text", "lang")


@query("json_list_safe", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a,u' || user_id ELSE '' END AS items FROM events""")
def _(v):
    raw = F.when(C("event_id") % 3 == 0, F.concat(F.lit(' ["a", "u'), C("user_id").cast("string"), F.lit('"]'))).when(
        C("event_id") % 3 == 1, C("props")).otherwise('["a", ')
    return v("events").select("event_id", F.array_join(readers.json_list_safe(raw), ",").alias("items"))


@query("file_triage", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unsupported extension'
    WHEN doc_id % 5 IN (3, 4) THEN 'content does not match extension' END AS reason FROM documents""")
def _(v):
    k = C("doc_id") % 5
    path = F.concat(F.lit("/in/"), C("doc_id").cast("string"), F.when(k == 0, ".txt").when(k == 1, ".PDF").when(
        k == 2, ".docx").when(k == 3, ".pdf").otherwise(".docx"))
    head = F.when(k == 1, F.lit("25504446")).when(k == 2, F.lit("504B0304")).otherwise(F.lit("20"))
    body = F.concat(F.unhex(head), F.encode(C("text"), "UTF-8"))
    files = v("documents").select("doc_id", path.alias("path"), body.alias("content")).withColumn("length", F.length("content"))
    done = readers.file_triage(files)
    return done.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("doc_id"), "reason")


@query("bulk_import", """SELECT candidate_id, CASE WHEN candidate_id IS NULL THEN 'Newcomer ' || k ELSE name END AS name, coalesce(email, new_email) AS email,
    CASE WHEN github_url IS NOT NULL THEN github_url WHEN sent THEN 'https://code.example.com/new' || k END AS github_url,
    CASE WHEN candidate_id IS NULL THEN 'created' WHEN sent THEN 'updated' ELSE 'kept' END AS action FROM (
      SELECT candidate_id, c.candidate_id AS k, name, email, NULL AS new_email, github_url, email IS NOT NULL AND candidate_id % 4 <> 3 AS sent FROM candidates c
      UNION ALL SELECT NULL, c_custkey, NULL, NULL, 'new' || c_custkey || '@example.net', NULL, true FROM customer WHERE c_custkey % 4 = 3)""")
def _(v):
    rows = readers.read_import_csv(v.spark, _import_files(v))[0]
    return readers.bulk_import(rows, v("candidates").select("candidate_id", "name", "email", "github_url"))[0]


PARTS = 8


def _import_files(v):
    """The import as CSV files, one per part in the order of ids. Every third row has a note on two lines."""
    k = C("row_no") - 2
    note = F.when(k % 3 == 0, F.concat(F.lit('says "hi", twice\n'), k.cast("string"))).otherwise(F.lit("plain, one line"))
    rows = _import_rows(v).select((k % PARTS).alias("part"), "name", note.alias("Note"), C("email").alias(" EMAIL "), "github_url", k.alias("id"))
    folder = run.work_folder(v.spark, "import")
    rows.repartition(PARTS, "part").sortWithinPartitions("part", "id").write.partitionBy("part").csv(
        folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return folder


@query("import_lines", f"""WITH r AS (SELECT candidate_id AS id, candidate_id % {PARTS} AS part, CASE WHEN candidate_id % 3 = 0 THEN 2 ELSE 1 END AS n,
      CASE WHEN candidate_id % 4 = 3 THEN 'NEW' || candidate_id || '@example.net' ELSE coalesce(upper(email), '') END AS email FROM candidates)
  SELECT CAST(part AS INT) AS part, CAST(id AS BIGINT) AS id, CAST(2 + coalesce(sum(n) OVER (PARTITION BY part ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_no, email,
    CASE WHEN n = 2 THEN 'says "hi", twice' || chr(10) || id ELSE 'plain, one line' END AS note FROM r""")
def _(v):
    rows = readers.read_import_csv(v.spark, _import_files(v))[0]
    return rows.select(
        F.regexp_extract("file", r"part=(\d+)", 1).cast("int").alias("part"), C("id").cast("long").alias("id"), "row_no", "email", "note")


def _import_rows(v):
    k = C("candidate_id")
    return v("candidates").select(
        (k + 2).alias("row_no"),
        F.when(k % 4 == 3, F.concat(F.lit("Newcomer "), k.cast("string"))).otherwise("").alias("name"),
        F.when(k % 4 == 3, F.concat(F.lit("NEW"), k.cast("string"), F.lit("@example.net"))).otherwise(
            F.coalesce(F.upper("email"), F.lit(""))).alias("email"),
        F.concat(F.lit("https://code.example.com/new"), k.cast("string")).alias("github_url"))


@query("bulk_import_errors", """SELECT candidate_id + 2 AS row_no, 'row without name and address' AS reason
  FROM candidates WHERE email IS NULL AND candidate_id % 4 <> 3""")
def _(v):
    return readers.bulk_import(_import_rows(v), v("candidates").select("candidate_id", "name", "email"))[1]


@query("export_csv", f"""WITH {BOARD}, {LAST} SELECT b.name AS candidate_name, coalesce(b.email, '') AS email, '' AS phone, '' AS current_title, b.level AS experience_level,
    b.years_experience, b.stage, round_even(total_score, 1) AS total_score, round_even(project_score, 1) AS project_score, round_even(skill_score, 1) AS skill_score,
    round_even(education_score, 1) AS education_score, coalesce(latest_status, '') AS recommendation, '' AS linkedin_url, coalesce(github_url, '') AS github_url,
    '' AS portfolio_url, r.title AS job_role, strftime(evaluated_at, '%Y-%m-%d %H:%M') AS evaluated_at
  FROM board b JOIN roles r ON r.role_id = b.role_id LEFT JOIN last_log l ON l.evaluation_id = b.evaluation_id
  WHERE b.evaluation_id IN (SELECT evaluation_id FROM status_log WHERE status = 'shortlisted')""")
def _(v):
    return sinks.export_csv(_board(v), v("status_log"), v("roles"), status="shortlisted")


# Four runs per pair in changing order of scores and stops, and pairs that are not stored yet.
INCOMING = """incoming AS (SELECT role_id, version_id + CASE WHEN version_id % 7 = 0 THEN 100000000 ELSE 0 END AS doc_id,
    evaluated_at + make_interval_hours AS evaluated_at, CAST(total_score / 2 + k AS DOUBLE) AS total_score,
    CASE (version_id // 3 + k * (1 + version_id % 4)) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'tfidf_filtered' WHEN 2 THEN 'experience_filtered' WHEN 3 THEN 'queued' ELSE 'none' END AS eval_status
    FROM evals JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) runs ON k < 1 + version_id % 4)"""
INCOMING_DUCK = INCOMING.replace("make_interval_hours", "to_hours(k)")
INCOMING_SPARK = INCOMING.replace("make_interval_hours", "make_interval(0, 0, 0, 0, k)").replace("version_id // 3", "version_id DIV 3")


@query("upsert_evaluations", f"""WITH {INCOMING_DUCK}, r AS (SELECT role_id, doc_id, arg_min({{'t': total_score, 's': eval_status}}, evaluated_at) AS f,
      max(evaluated_at) FILTER (eval_status IS NULL) AS score_at, arg_max(total_score, evaluated_at) FILTER (eval_status IS NULL) AS score,
      max(evaluated_at) FILTER (eval_status = 'experience_filtered') AS early_at, arg_max(total_score, evaluated_at) FILTER (eval_status = 'experience_filtered') AS early,
      max(evaluated_at) FILTER (eval_status = 'tfidf_filtered') AS weak_at, arg_max(total_score, evaluated_at) FILTER (eval_status = 'tfidf_filtered') AS weak
      FROM incoming GROUP BY role_id, doc_id),
    b AS (SELECT coalesce(e.role_id, r.role_id) AS role_id, coalesce(e.version_id, r.doc_id) AS doc_id, f, score_at, score, early_at, early, weak_at, weak, e.version_id IS NOT NULL AS stored,
        CASE WHEN score_at IS NOT NULL THEN NULL WHEN e.version_id IS NOT NULL THEN e.eval_status ELSE f.s END AS s0,
        CASE WHEN score_at IS NOT NULL THEN score WHEN e.version_id IS NOT NULL THEN e.total_score ELSE f.t END AS t0
      FROM evals e FULL JOIN r ON r.role_id = e.role_id AND r.doc_id = e.version_id),
    c AS (SELECT *, early_at IS NOT NULL AND (score_at IS NULL OR early_at > score_at) AND (s0 IS NULL OR s0 IN ('experience_filtered', 'tfidf_filtered', 'queued')) AS take_early,
        weak_at IS NOT NULL AND (score_at IS NULL OR weak_at > score_at) AND (s0 IS NULL OR s0 IN ('tfidf_filtered', 'queued')) AS take_weak FROM b)
  SELECT role_id, doc_id, CASE WHEN take_early THEN early WHEN take_weak THEN weak ELSE t0 END AS total_score,
    CASE WHEN take_early THEN 'experience_filtered' WHEN take_weak THEN 'tfidf_filtered' ELSE s0 END AS eval_status FROM c""")
def _(v):
    incoming = v.sql(f"SELECT * FROM ({INCOMING_SPARK.split('AS (', 1)[1][:-1]})")
    stored = v("evals").select("role_id", C("version_id").alias("doc_id"), "evaluated_at", "total_score", "eval_status")
    return sinks.upsert_evaluations(stored, incoming).select("role_id", "doc_id", "total_score", "eval_status")


@query("append_audit", """SELECT c_custkey AS target_id, 'update' AS action, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '>NONE' END AS segment_change,
    CASE WHEN c_custkey % 2 = 0 THEN c_name || '>' || upper(c_name) END AS name_change FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def _(v):
    old = v("customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.withColumn("c_mktsegment", F.when(C("c_custkey") % 3 == 0, "NONE").otherwise(C("c_mktsegment"))).withColumn(
        "c_name", F.when(C("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(C("c_name")))
    rows = sinks.append_audit(old, new, "c_custkey", ["c_name", "c_mktsegment"], "update")
    return rows.select(
        "target_id", "action", F.array_join(F.try_element_at("changes", F.lit("c_mktsegment")), ">").alias("segment_change"),
        F.array_join(F.try_element_at("changes", F.lit("c_name")), ">").alias("name_change"))


# -- near-duplicates -------------------------------------------------------------------------------

BITS = ", ".join(
    f"CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN n ELSE -n END) > 0 THEN {2**b} ELSE 0 END" for b in range(63))
FPS = r"""body AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[^\p{L}\p{N}_]+', '', 'g') AS t FROM documents),
  shingles AS (SELECT doc_id, substr(t, i, 4) AS s, count(*) AS n FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 3, 1) + 1)) AS i FROM body) GROUP BY 1, 2),
  hashed AS (SELECT doc_id, n, ('0x' || substr(md5(s), 17, 16))::UBIGINT AS h FROM shingles),
  fps AS MATERIALIZED (SELECT doc_id, CAST(list_sum([""" + BITS + r"""]) - CASE WHEN sum(CASE WHEN (h >> 63) & 1 = 1 THEN n ELSE -n END) > 0 THEN 9223372036854775808 ELSE 0 END AS BIGINT) AS fp
    FROM hashed GROUP BY doc_id)"""
PAIRS = """reps AS MATERIALIZED (SELECT fp, min(doc_id) AS rep FROM fps GROUP BY fp),
  pairs AS MATERIALIZED (SELECT x.rep AS a, y.rep AS b, CAST(bit_count(xor(x.fp, y.fp)) AS INT) AS bits FROM reps x JOIN reps y ON x.rep < y.rep AND bit_count(xor(x.fp, y.fp)) <= 3
    UNION ALL SELECT rep, doc_id, 0 FROM fps JOIN reps USING (fp) WHERE doc_id <> rep)"""


def _fps(v):
    """Fingerprints are stored with the document versions: computed once, read by every later step."""
    return v.keep("fps", lambda: dedup.simhash(v("documents")))


@query("simhash", f"WITH {FPS} SELECT doc_id, fp FROM fps")
def _(v):
    return dedup.simhash(v("documents"))


@query("near_dup_pairs", f"WITH {FPS}, {PAIRS} SELECT a, b, bits FROM pairs")
def _(v):
    return dedup.near_dup_pairs(_fps(v))


OWNED = """owned AS MATERIALIZED (SELECT source, fp, min(doc_id) AS rep FROM fps JOIN documents USING (doc_id) GROUP BY source, fp),
  owner_pairs AS (SELECT x.source, x.rep AS a, y.rep AS b, CAST(bit_count(xor(x.fp, y.fp)) AS INT) AS bits FROM owned x JOIN owned y ON x.source = y.source AND x.rep < y.rep
      AND bit_count(xor(x.fp, y.fp)) <= 10
    UNION ALL SELECT o.source, rep, f.doc_id, 0 FROM fps f JOIN documents d USING (doc_id) JOIN owned o ON o.source = d.source AND o.fp = f.fp WHERE f.doc_id <> rep)"""


def _owned(v):
    return v.keep("owned_fps", lambda: v("documents").select("doc_id", "source").join(by_shuffle(_fps(v)), "doc_id").select("doc_id", "fp", "source"))


@query("near_dup_same_owner", f"WITH {FPS}, {OWNED} SELECT source, a, b, bits FROM owner_pairs")
def _(v):
    return dedup.near_dup_same_owner(_owned(v), "source")


@query("dup_status", f"""WITH {FPS}, d AS (SELECT x.doc_id, min(y.doc_id) AS m FROM fps x JOIN fps y ON y.doc_id < x.doc_id AND bit_count(xor(x.fp, y.fp)) <= 3 GROUP BY x.doc_id),
    s AS (SELECT f.*, source FROM fps f JOIN documents USING (doc_id)),
    n AS (SELECT x.doc_id, min(y.doc_id) AS m FROM s x JOIN s y ON y.source = x.source AND y.doc_id < x.doc_id AND bit_count(xor(x.fp, y.fp)) <= 10 GROUP BY x.doc_id)
  SELECT f.doc_id, CASE WHEN d.m IS NOT NULL THEN 'duplicate' WHEN n.m IS NOT NULL THEN 'near_duplicate' ELSE 'unique' END AS status, coalesce(d.m, n.m) AS match_id
  FROM fps f LEFT JOIN d USING (doc_id) LEFT JOIN n USING (doc_id)""")
def _(v):
    fps = _owned(v)
    return dedup.dup_status(fps, dedup.near_dup_links(fps), dedup.near_dup_links(fps, 10, 11, 1, "source"), "source")


@query("dup_clusters", f"""WITH RECURSIVE {FPS}, {PAIRS}, e AS MATERIALIZED (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
    reach AS (SELECT u, u AS r FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.r)
  SELECT u AS doc_id, min(r) AS cluster_id, u = min(r) AS keep FROM reach GROUP BY u""")
def _(v):
    links = dedup.near_dup_links(_fps(v))
    members = dedup.near_dup_classes(_fps(v), links)
    several = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class_id")
    return salted_join(members, several, "class_id").select("doc_id", C("class_id").alias("cluster_id"), (C("doc_id") == C("class_id")).alias("keep"))


@query("near_dup_classes", f"""WITH RECURSIVE {FPS}, {PAIRS}, e AS MATERIALIZED (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
    reach AS (SELECT u, u AS r FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.r),
    low AS (SELECT u, min(r) AS r FROM reach GROUP BY u), near AS (SELECT u, count(*) AS n FROM (SELECT a AS u FROM pairs WHERE bits > 0 UNION ALL SELECT b FROM pairs WHERE bits > 0) GROUP BY u)
  SELECT doc_id, rep, coalesce(r, rep) AS class_id, coalesce(n, 0) AS n_links FROM fps JOIN reps USING (fp) LEFT JOIN low ON low.u = rep LEFT JOIN near ON near.u = rep""")
def _(v):
    return dedup.near_dup_classes(_fps(v), dedup.near_dup_links(_fps(v)))


@query("dup_first_come", f"""WITH RECURSIVE {FPS}, o AS MATERIALIZED (SELECT doc_id, fp, row_number() OVER (ORDER BY doc_id) AS rn FROM fps),
    s AS (SELECT rn, doc_id, true AS kept, [fp] AS log FROM o WHERE rn = 1
      UNION ALL SELECT rn, doc_id, ok, CASE WHEN ok THEN list_append(log, fp) ELSE log END
      FROM (SELECT o.rn, o.doc_id, o.fp, s.log, len(list_filter(s.log, lambda x: bit_count(xor(x, o.fp)) <= 3)) = 0 AS ok FROM s JOIN o ON o.rn = s.rn + 1) q)
  SELECT doc_id, kept FROM s""")
def _(v):
    return dedup.first_come(_fps(v), dedup.near_dup_pairs(_fps(v)))


# -- sections --------------------------------------------------------------------------------------

HEADERS = "headers AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{h}', '{kind}', {i})" for i, (h, kind) in enumerate((h, kind) for kind, names in lists.SECTION_HEADERS for h in names)
) + ") AS t(header, type, place))"
WEIGHTS = "CASE type " + " ".join(f"WHEN '{k}' THEN {w}E0" for k, w in lists.SECTION_WEIGHTS.items()) + " ELSE 0.2E0 END"
SECTIONS = HEADERS + r""", ln AS (SELECT doc_id, ls, unnest(range(0, len(ls))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM SRC)),
  cand AS (SELECT doc_id, n, regexp_replace(ls[n + 1], '^\s+|\s+$', '', 'g') AS title FROM ln),
  cand2 AS (SELECT *, regexp_replace(title, ':+$', '') AS core FROM cand WHERE length(title) BETWEEN 2 AND 60 AND NOT regexp_matches(title, '^[\-*•◦▪▸►]')
    AND NOT regexp_matches(title, '[.?!]$') AND regexp_matches(title, '\p{L}')),
  cand3 AS (SELECT *, lower(core) AS word FROM cand2 WHERE NOT regexp_matches(core, '(?:^|\s)[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') OR (upper(core) = core AND regexp_matches(core, '\p{Lu}')) OR title LIKE '%:'),
  words AS (SELECT DISTINCT word FROM cand3),
  fuzzy AS (SELECT word, arg_min(type, levenshtein(word, header) * 1000 + place) AS type, min(levenshtein(word, header)) AS d FROM words JOIN headers ON abs(length(word) - length(header)) <= 2
    AND levenshtein(word, header) <= 2 GROUP BY word),
  heads AS (SELECT doc_id, n, title, type, CASE WHEN d = 0 THEN 1.0E0 ELSE 0.85E0 END AS confidence, lead(n) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM cand3 JOIN fuzzy USING (word)),
  sections AS (SELECT h.doc_id, type, title, CAST(n AS INT) AS start_line, CAST(coalesce(nxt - 1, len(ls) - 1) AS INT) AS end_line,
      regexp_replace(array_to_string(ls[n + 2:coalesce(nxt - 1, len(ls) - 1) + 1], chr(10)), '^\s+|\s+$', '', 'g') AS text, confidence, """ + WEIGHTS + r""" AS weight
    FROM heads h JOIN (SELECT doc_id, string_split(text, chr(10)) AS ls FROM SRC) USING (doc_id)
    UNION ALL SELECT doc_id, 'other', '', 0, CAST(len(string_split(text, chr(10))) - 1 AS INT), text, 0.5E0, 0.2E0 FROM SRC WHERE doc_id NOT IN (SELECT doc_id FROM heads))"""


@query("segment", "WITH " + SECTIONS.replace("SRC", "profile_docs") + " SELECT * FROM sections")
def _(v):
    return segment.segment(v("profile_docs"))


@query("segment_documents", "WITH " + SECTIONS.replace("SRC", "documents") + " SELECT * FROM sections")
def _(v):
    return segment.segment(v("documents"))


@query("section_spans", r"""WITH ln AS (SELECT doc_id, CAST(unnest(range(0, len(ls))) AS INT) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM profile_docs)),
    m AS (SELECT *, CASE WHEN line IN ('EXPERIENCE', 'Skills', 'Education:', 'Projects') THEN line END AS header FROM ln),
    g AS (SELECT *, count(header) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM m)
  SELECT doc_id, max(header) AS type, min(n) AS start_line, max(n) AS end_line,
    coalesce(regexp_replace(string_agg(CASE WHEN header IS NULL THEN line END, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g'), '') AS text
  FROM g WHERE k > 0 GROUP BY doc_id, k""")
def _(v):
    lines = v("profile_docs").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    marked = lines.withColumn("header", F.when(C("line").isin("EXPERIENCE", "Skills", "Education:", "Projects"), C("line")))
    return segment.section_spans(marked)


@query("fuzzy_header_join", f"""WITH {HEADERS}, terms AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term FROM (
      SELECT text FROM profile_docs UNION ALL SELECT text FROM documents))
  SELECT term, arg_min(type, levenshtein(term, header) * 1000 + place) AS section, CAST(min(levenshtein(term, header)) AS INT) AS distance
  FROM terms JOIN headers ON abs(length(term) - length(header)) <= 2 AND levenshtein(term, header) <= 2 GROUP BY term""")
def _(v):
    texts = v("profile_docs").select("text").unionByName(v("documents").select("text"))
    terms = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w")).select(F.lower("w").alias("term"))
    return segment.fuzzy_header_join(terms)


@query("centroid_classify", """WITH x AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT label, i, avg(x) AS m FROM x WHERE vec_id % 5 <> 0 GROUP BY label, i),
    s AS (SELECT vec_id, m.label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cosine FROM x JOIN m ON m.i = x.i WHERE vec_id % 5 = 0 GROUP BY vec_id, m.label)
  SELECT vec_id, label, round_even(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS rn FROM s) WHERE rn = 1 AND cosine > 0.3""")
def _(v):
    e = v("embeddings")
    out = segment.centroid_classify(e.filter("vec_id % 5 = 0"), e.filter("vec_id % 5 <> 0"), 0.3)
    return out.withColumn("cosine", F.bround("cosine", 6))


# -- dictionary ------------------------------------------------------------------------------------

@query("dictionary_match", """SELECT doc_id, term FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents)
  JOIN dict_terms ON term = token""")
def _(v):
    texts = v("documents").select(C("doc_id").alias("text_id"), "text")
    return dictionary.dictionary_match(texts, v("dict_terms")).select(C("text_id").alias("doc_id"), "term")


@query("dictionary_match_substring", "SELECT doc_id, term FROM documents JOIN dict_terms ON contains(lower(text), term)")
def _(v):
    texts = v("documents").select(C("doc_id").alias("text_id"), "text")
    return dictionary.dictionary_match(texts, v("dict_terms"), "substring").select(C("text_id").alias("doc_id"), "term")


UNION = """found AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) JOIN dict_terms ON term = token),
    ext AS (SELECT doc_id, term FROM documents JOIN dict_terms ON contains(lower(text), term))"""


@query("union_skill_sources", f"""WITH {UNION} SELECT e.doc_id, CASE WHEN f.term IS NOT NULL THEN f.term ELSE upper(e.term) END AS skill, t.term_id % 2 = 0 AS is_required,
    CASE WHEN t.term_id <= 25 THEN t.term_id END AS skill_id, t.term_id > 25 AS is_new
  FROM ext e JOIN dict_terms t ON t.term = e.term LEFT JOIN found f ON f.doc_id = e.doc_id AND f.term = e.term""")
def _(v):
    texts = v("documents").select(C("doc_id").alias("text_id"), "text")
    terms = v("dict_terms")
    rules = dictionary.dictionary_match(texts, terms).select("text_id", C("term").alias("skill"), F.lit(True).alias("is_required"))
    outside = dictionary.dictionary_match(texts, terms, "substring").join(terms, "term").select(
        "text_id", F.upper("term").alias("skill"), (C("term_id") % 2 == 0).alias("is_required"), F.lit(True).alias("refines"))
    known = terms.filter("term_id <= 25").select(C("term").alias("skill"), C("term_id").cast("long").alias("skill_id"))
    out = sets.union_skill_sources([rules, outside], known)
    return out.select(C("text_id").alias("doc_id"), "skill", "is_required", "skill_id", "is_new")


@query("union_projects", r"""SELECT owner, name, language, stars, NULL AS description, 'github' AS source FROM repos
  UNION ALL SELECT page_id, h, NULL, NULL, h, 'portfolio' FROM (SELECT page_id, trim(regexp_replace(replace(regexp_replace(
    unnest(regexp_extract_all(html, '(?is)<h[1-4][^>]*>(.*?)</h[1-4]>', 1)), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS h FROM pages) WHERE length(h) BETWEEN 5 AND 199""")
def _(v):
    pages = v("pages").select(C("page_id").alias("owner"), F.explode(page_headings(C("html"))).alias("description"))
    return sets.union_projects(v("repos").select("owner", "name", "language", "stars"), pages).select(
        "owner", "name", "language", "stars", "description", "source")


# -- relevance -------------------------------------------------------------------------------------

def _tf(src: str, key: str, text: str, n: int, pattern: str, out: str) -> str:
    grams = " UNION ALL ".join(
        f"SELECT {key}, array_to_string(w[i:i + {k - 1}], ' ') AS term FROM (SELECT {key}, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM {out}_w)"
        for k in range(1, n + 1))
    return f"""{out}_w AS (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS w FROM {src}),
    {out} AS (SELECT {key}, term, 1 + ln(count(*)) AS w FROM ({grams}) GROUP BY {key}, term)"""


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s+#.\-]', ' ', 'g'), '\s+', ' ', 'g'))"


def cosine_sql(pairs: str) -> str:
    return f"""sh AS (SELECT p.doc_id, p.role_id, sum(a.w * b.w) AS dot, sum(a.w * a.w) AS a_sh, sum(b.w * b.w) AS b_sh
      FROM {pairs} p JOIN dt a ON a.doc_id = p.doc_id JOIN rt b ON b.role_id = p.role_id AND b.term = a.term GROUP BY 1, 2),
    da AS (SELECT doc_id, sum(w * w) AS a_all FROM dt GROUP BY 1), rb AS (SELECT role_id, sum(w * w) AS b_all FROM rt GROUP BY 1),
    cosine AS (SELECT p.doc_id, p.role_id, coalesce(dot / (sqrt((a_all - a_sh) * pow(1 + ln(1.5), 2) + a_sh) * sqrt((b_all - b_sh) * pow(1 + ln(1.5), 2) + b_sh)), 0) AS c
      FROM {pairs} p LEFT JOIN sh USING (doc_id, role_id) LEFT JOIN da USING (doc_id) LEFT JOIN rb USING (role_id))"""


ACCENT_FREE = "strip_accents({})"


@query("tfidf_relevance", f"""WITH {_tf('documents', 'doc_id', ACCENT_FREE.format(norm_sql('text')), 2, '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}', 'dt')},
    {_tf('role_texts', 'role_id', ACCENT_FREE.format(norm_sql('description')), 2, '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}', 'rt')}, {cosine_sql('doc_applications')}
  SELECT doc_id, role_id, round_even(c, 4) AS score FROM cosine""")
def _(v):
    return tfidf.tfidf_relevance(
        v("documents"), v("role_texts").withColumnRenamed("description", "role_doc"), v("doc_applications"))


ALIGN = SECTIONS.replace("SRC", "profile_docs") + f""",
    body AS (SELECT doc_id, string_agg(text, ' ' ORDER BY start_line) FILTER (type IN ('projects', 'experience')) AS work, string_agg(text, ' ' ORDER BY start_line) AS whole FROM sections GROUP BY doc_id),
    chosen AS (SELECT doc_id, coalesce(work, whole) AS text FROM body),
    {_tf('chosen', 'doc_id', norm_sql('text'), 3, '[a-z0-9][a-z0-9+#' + chr(92) + '-.]*', 'dt')}, {_tf('role_desc', 'role_id', norm_sql('description'), 3, '[a-z0-9][a-z0-9+#' + chr(92) + '-.]*', 'rt')},
    {cosine_sql('applications')}, align AS (SELECT doc_id, role_id, least(c * 2.5, 1.0) AS jd FROM cosine)"""


@query("jd_alignment", f"WITH {ALIGN} SELECT doc_id, role_id, round_even(jd, 6) AS score FROM align")
def _(v):
    sections = segment.segment(v("profile_docs"))
    return tfidf.jd_alignment(sections, v("role_desc"), v("applications")).withColumn("score", F.bround("score", 6))


# -- entries ---------------------------------------------------------------------------------------

@query("project_names", "WITH " + SECTIONS.replace("SRC", "profile_docs") + r""", pl AS (SELECT doc_id, start_line, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (
      SELECT doc_id, start_line, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM sections WHERE type = 'projects')),
    ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line, pos) AS rn FROM pl WHERE length(line) BETWEEN 4 AND 80
      AND NOT regexp_matches(line, '^[•\-*–]') AND NOT regexp_matches(line, '\d{4}'))
  SELECT doc_id, line AS project_name FROM ok""")
def _(v):
    return flags.project_names(segment.segment(v("profile_docs")))


@query("experience_entries", """SELECT owner AS doc_id, CASE WHEN range_id % 9 = 0 THEN 'Intern' ELSE 'Engineer' END AS company, CAST(NULL AS VARCHAR) AS title,
    CAST(start_year AS VARCHAR) AS "start", CAST(end_year AS VARCHAR) AS "end" FROM profile_ranges""")
def _(v):
    return flags.experience_entries(segment.segment(v("profile_docs")))
