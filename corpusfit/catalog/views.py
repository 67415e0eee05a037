"""Input views derived from the given tables, written once for Spark and DuckDB.

``LINES_AGG(value, key)`` joins strings with a line feed in key order and
``LIST_AGG(value, key)`` with ", "; both are rewritten for each dialect.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusfit.scale import ensure_checkpoint_dir

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

AS_OF_YEAR = 2002

VIEWS: dict[str, str] = {
    "candidates": """
        SELECT c_custkey AS candidate_id, c_name AS name,
          CASE WHEN c_custkey % 10 = 0 THEN NULL
               ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
          CASE c_custkey % 7 WHEN 0 THEN 'applied' WHEN 1 THEN 'screening' WHEN 2 THEN 'coding'
               WHEN 3 THEN 'interview' WHEN 4 THEN 'offer' WHEN 5 THEN 'hired' ELSE 'rejected' END AS stage,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 13 AS DOUBLE) END AS years_experience,
          CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(1990 + c_custkey % 13 AS INT) END AS graduation_year,
          c_acctbal < 0 AS needs_review,
          c_custkey % 19 = 0 AS deleted,
          CASE WHEN c_custkey % 3 = 0 THEN NULL
               ELSE 'https://code.example.com/u' || CAST(c_custkey AS STRING) END AS github_url,
          CASE WHEN c_custkey % 17 <> 0 AND 1990 + c_custkey % 13 >= 2001 THEN 'entry'
               WHEN c_custkey % 11 = 0 THEN 'entry'
               WHEN c_custkey % 13 < 1 THEN 'entry' WHEN c_custkey % 13 < 3 THEN 'junior'
               WHEN c_custkey % 13 < 5 THEN 'mid' WHEN c_custkey % 13 < 10 THEN 'senior'
               ELSE 'executive' END AS level,
          c_mktsegment AS title
        FROM customer""",
    "roles": """
        SELECT role_id, title, role_id AS min_experience,
          CAST(50 + 5 * role_id AS DOUBLE) AS min_fit_score,
          1992 AS min_graduation_year, 2001 AS max_graduation_year,
          50 AS weight_projects, 30 AS weight_skills,
          CASE WHEN role_id = 5 THEN 10 ELSE 20 END AS weight_education,
          role_id <= 2 AS require_github, CAST(100 * role_id AS BIGINT) AS shortlist_target,
          CASE WHEN role_id = 3 THEN 'junior, mid, senior' ELSE NULL END AS allowed_levels,
          role_id % 2 = 1 AS auto_email,
          CASE WHEN role_id = 4 THEN 'master' WHEN role_id = 2 THEN 'bachelor' ELSE NULL END AS min_degree,
          CASE WHEN role_id = 1 THEN 'Mechanical Engineering, Physics' ELSE NULL END AS preferred_majors,
          role_id = 1 AS is_entry_level,
          CASE WHEN role_id = 2 THEN 0.08 ELSE 0.0 END AS tfidf_threshold,
          role_id = 5 AS intake_paused
        FROM (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) AS role_id,
                     o_orderpriority AS title FROM orders)""",
    "evals": """
        SELECT o_orderkey AS evaluation_id, o_orderkey AS version_id, o_custkey AS candidate_id,
          CAST(substr(o_orderpriority, 1, 1) AS INT) AS role_id,
          total_score, total_score AS project_score,
          floor(total_score * 8 + 0.5) / 10 AS skill_score,
          floor(total_score * 6 + 0.5) / 10 AS education_score,
          o_orderdate AS evaluated_at,
          CASE WHEN o_orderstatus <> 'P' THEN NULL
               WHEN o_orderkey % 3 = 0 THEN 'tfidf_filtered'
               WHEN o_orderkey % 3 = 1 THEN 'experience_filtered' ELSE 'queued' END AS eval_status
        FROM (SELECT *, least(floor(o_totalprice / 450 + 0.5) / 10, 100.0) AS total_score FROM orders)""",
    "versions": """
        SELECT o_orderkey AS version_id, o_custkey AS candidate_id, o_orderdate AS uploaded_at,
          o_orderkey % 4 <> 0 AS is_current FROM orders""",
    "status_log": """
        SELECT l_orderkey AS evaluation_id,
          CASE l_returnflag WHEN 'A' THEN 'shortlisted' WHEN 'N' THEN 'review' ELSE 'rejected' END AS status,
          l_shipdate AS changed_at, l_linenumber AS seq, l_partkey AS ref_a, l_suppkey AS ref_b
        FROM lineitem""",
    "skills": """
        SELECT p_name AS skill, min(p_partkey) AS skill_id FROM part GROUP BY p_name""",
    "matches": """
        SELECT DISTINCT l_orderkey AS evaluation_id, p_name AS skill
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "role_skills": """
        SELECT CAST(skill_id % 5 + 1 AS INT) AS role_id, skill,
          CAST(floor(skill_id / 5) AS BIGINT) % 2 = 0 AS is_required, skill_id FROM skills""",
    "scored_docs": """
        SELECT doc_id AS candidate_id, (doc_id * 37 % 1001) / 10.0E0 AS total_score FROM documents""",
    "outcomes": """
        SELECT doc_id AS candidate_id,
          CASE WHEN quality = 1 THEN 'hired' ELSE 'rejected' END AS outcome FROM labels""",
    "landing": """
        SELECT event_id AS message_id, ts AS received_at, user_id, value,
          CASE event_type WHEN 'view' THEN 'processed' WHEN 'click' THEN 'new'
               WHEN 'signup' THEN 'no_attachment' WHEN 'purchase' THEN 'keyword_filtered'
               ELSE 'failed' END AS status FROM events""",
    "mail": """
        SELECT conv_id, turn, text AS subject FROM conversations WHERE role = 'user'""",
    "repos": """
        SELECT o_custkey AS owner, p_partkey AS repo_id, p_name AS name, p_brand AS language,
          CAST(p_size AS BIGINT) AS stars, max(l_shipdate) AS updated_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY o_custkey, p_partkey, p_name, p_brand, p_size""",
    "judgements": """
        SELECT doc_id, name, max(score) AS score, min(confidence) AS confidence, min(section) AS section
        FROM (SELECT l_orderkey AS doc_id, p_name AS name, l_quantity * 1.97E0 + 0.0137E0 AS score,
                CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence,
                CASE l_linestatus WHEN 'F' THEN 'projects' ELSE 'skills' END AS section
              FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY doc_id, name""",
    "feedback": """
        SELECT l_suppkey AS owner, CAST(l_linenumber % 5 + 1 AS DOUBLE) AS rating,
          CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity / 5 END AS technical,
          l_discount * 100 AS communication, l_tax * 100 AS culture_fit FROM lineitem""",
    "profile_ranges": """
        SELECT o_custkey AS owner, CAST(year(o_orderdate) AS INT) AS start_year,
          CAST(greatest(year(o_orderdate), coalesce(last_ship, year(o_orderdate))) AS INT) AS end_year,
          o_orderkey AS range_id
        FROM orders LEFT JOIN (SELECT l_orderkey, max(year(l_shipdate)) AS last_ship
                               FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey""",
    "profile_names": """
        SELECT c_custkey AS owner, first_name, last_name,
          CASE c_custkey % 4 WHEN 0 THEN first_name || ' ' || last_name
            WHEN 1 THEN upper(first_name || ' ' || last_name)
            WHEN 2 THEN last_name || ', ' || first_name
            ELSE 'Name: ' || first_name || ' ' || last_name || ' | +49 30 ' ||
                 CAST(1000000 + c_custkey AS STRING) || ' | mail' || CAST(c_custkey AS STRING) || '@example.org'
          END AS name_line
        FROM (SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS first_name,
                CASE c_custkey % 3 WHEN 0 THEN 'Nair' WHEN 1 THEN 'Okoro' ELSE 'Lindqvist' END AS last_name
              FROM customer)""",
    "profile_jobs": """
        SELECT owner, LINES_AGG(CASE WHEN range_id % 9 = 0 THEN 'Intern' ELSE 'Engineer' END || chr(10) ||
            CAST(start_year AS STRING) || ' - ' || CAST(end_year AS STRING), range_id) AS jobs
        FROM profile_ranges GROUP BY owner""",
    "profile_parts": """
        SELECT owner, LIST_AGG(name, name) AS part_names
        FROM (SELECT DISTINCT owner, name FROM repos) GROUP BY owner""",
    "owned_names": """
        SELECT DISTINCT owner, name FROM repos""",
    "profile_docs": """
        SELECT n.owner AS doc_id,
          name_line || chr(10) || 'EXPERIENCE' || chr(10) || coalesce(jobs, '') || chr(10) ||
          CASE WHEN n.owner % 3 = 0 THEN 'Skils' ELSE 'Skills' END || chr(10) || coalesce(part_names, '') || chr(10) ||
          CASE WHEN n.owner % 5 = 0 THEN 'Projects' || chr(10) || replace(coalesce(part_names, ''), ', ', chr(10)) || chr(10) || 'Deployed ' || coalesce(part_names, 'nothing') ||
               ' with docker and 4 years of red widget work (coursework)' || chr(10) ELSE '' END ||
          'Education:' || chr(10) || 'Bachelor of Engineering ' ||
          CAST(1990 + n.owner % 13 AS STRING) AS text
        FROM profile_names n LEFT JOIN profile_jobs j ON j.owner = n.owner
        LEFT JOIN profile_parts p ON p.owner = n.owner""",
    "applications": """
        SELECT DISTINCT o_custkey AS doc_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS role_id FROM orders""",
    "doc_applications": """
        SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS role_id FROM documents""",
    "role_texts": """
        SELECT item_id AS role_id, text AS description FROM benchmark""",
    "role_desc": """
        SELECT role_id, 'Engineer and intern work with ' || part_names || ' and red widget c++ docker' AS description
        FROM (SELECT role_id, LIST_AGG(skill, skill) AS part_names FROM role_skills GROUP BY role_id)""",
    "role_config": """
        SELECT r.*, d.description, 0.05E0 AS cosine_threshold
        FROM roles r LEFT JOIN role_desc d ON d.role_id = r.role_id""",
    "rules": """
        SELECT role_id, skill_id AS rule_id, req_type, 100.0E0 / count(*) OVER (PARTITION BY role_id) AS weight,
          CASE req_type WHEN 'education' THEN 'Bachelor of engineering ' || skill
               WHEN 'experience' THEN 'engineer ' || skill || ' 3 years' ELSE skill END AS label,
          CASE WHEN req_type = 'experience' AND skill_id % 3 = 0 THEN 2 END AS min_years
        FROM (SELECT *, CASE skill_id % 4 WHEN 0 THEN 'skill' WHEN 1 THEN 'experience'
                WHEN 2 THEN 'education' ELSE 'other' END AS req_type FROM role_skills WHERE role_id IN (2, 4))""",
    "pair_people": """
        SELECT a.doc_id, a.role_id, c.years_experience, c.level, c.graduation_year,
          a.role_id = 1 OR c.level = 'entry' OR coalesce(c.graduation_year >= 2001, false) AS fresher
        FROM applications a JOIN candidates c ON c.candidate_id = a.doc_id""",
    "companies_left": """
        SELECT owner, company, max(ym) AS end_month FROM (
          SELECT o_custkey AS owner, p_brand AS company,
            CAST(year(o_orderdate) AS STRING) || '-' || right('0' || CAST(month(o_orderdate) AS STRING), 2) AS ym
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
          WHERE l_linenumber IN (2, 4, 6)) GROUP BY owner, company""",
    "companies_right": """
        SELECT owner, company, max(ym) AS end_month FROM (
          SELECT o_custkey AS owner, upper(p_brand) AS company,
            CAST(year(l_shipdate) AS STRING) || '-' || right('0' || CAST(month(l_shipdate) AS STRING), 2) AS ym
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
          WHERE l_linenumber NOT IN (2, 4, 6)) GROUP BY owner, company""",
    "token_docs": """
        SELECT DISTINCT doc_id, token FROM (
          SELECT doc_id, WORDS(text) AS token FROM documents) WHERE token <> ''""",
    "dict_terms": """
        SELECT token AS term, term_id FROM (
          SELECT token, row_number() OVER (ORDER BY n DESC, token) AS term_id
          FROM (SELECT token, count(*) AS n FROM token_docs GROUP BY token)) WHERE term_id <= 2000""",
}

# The same rows in forms that Spark takes less memory for. Nearly every line is a group of its own, so a first aggregate beside the
# join would hold all lines of a task: joined lines are dealt out first, to {tasks} tasks that follow the size of the lines' table, and
# they are grouped by two keys before they meet the part's values.
SPARK_FORMS: dict[str, str] = {
    "repos": """
        SELECT owner, repo_id, p_name AS name, p_brand AS language, CAST(p_size AS BIGINT) AS stars, updated_at
        FROM (SELECT owner, repo_id, max(shipped) AS updated_at
              FROM (SELECT /*+ REPARTITION({tasks}, owner, repo_id) */ o_custkey AS owner, l_partkey AS repo_id, l_shipdate AS shipped
                    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY owner, repo_id)
        JOIN (SELECT DISTINCT p_partkey, p_name, p_brand, p_size FROM part) ON repo_id = p_partkey""",
    "owned_names": """
        SELECT DISTINCT owner, name
        FROM (SELECT /*+ REPARTITION({tasks}, owner) */ o_custkey AS owner, p_name AS name
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "profile_parts": """
        SELECT owner, LIST_AGG(name, name) AS part_names FROM owned_names GROUP BY owner""",
}
#: Bytes of the lines' files per task.
LINES_PER_TASK = 8 << 20

# A document's words are made distinct in its own row, so that only sums by word are shuffled; ids that stand more than once, which those sums
# would count twice, go the way of the view. The first words are chosen in every task before one task numbers them.
_WORD_SET = "explode(array_distinct(regexp_extract_all(lower(text), '[a-z0-9]+', 0)))"
_REPEATED = "(SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1) r ON r.doc_id <=> d.doc_id"
WORD_FORMS: dict[str, str] = {
    "dict_terms": f"""
        SELECT token AS term, row_number() OVER (ORDER BY n DESC, token) AS term_id
        FROM (SELECT token, sum(n) AS n FROM (
            SELECT token, count(*) AS n FROM (SELECT {_WORD_SET} AS token FROM documents d LEFT ANTI JOIN {_REPEATED}) GROUP BY token
            UNION ALL SELECT token, count(*) AS n
            FROM (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, {_WORD_SET} AS token FROM documents d LEFT SEMI JOIN {_REPEATED})) GROUP BY token)
          GROUP BY token ORDER BY n DESC, token LIMIT 2000)""",
}

_SPARK = {
    "LINES_AGG": r"listagg(\1, chr(10)) WITHIN GROUP (ORDER BY \2)",
    "LIST_AGG": r"listagg(\1, ', ') WITHIN GROUP (ORDER BY \2)",
    "WORDS": r"explode(regexp_extract_all(lower(\1), '[a-z0-9]+', 0))",
}
_DUCK = {
    "LINES_AGG": r"string_agg(\1, chr(10) ORDER BY \2)",
    "LIST_AGG": r"string_agg(\1, ', ' ORDER BY \2)",
    "WORDS": r"unnest(regexp_extract_all(lower(\1), '[a-z0-9]+'))",
}
_PATTERNS = {
    "LINES_AGG": r"LINES_AGG\((.*?), (\w+)\) AS",
    "LIST_AGG": r"LIST_AGG\((\w+), (\w+)\) AS",
    "WORDS": r"WORDS\((\w+)\) AS",
}


def _dialect(sql: str, rules: dict[str, str]) -> str:
    for name, replacement in rules.items():
        sql = re.sub(_PATTERNS[name], replacement + " AS", sql, flags=re.S)
    return sql


def _needed(body: str, names: list[str], views: dict[str, str] = VIEWS) -> list[str]:
    """Views used by ``body``, dependencies first, in a stable order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in names:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(views[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    return ordered


def duck_sql(body: str) -> str:
    """Prefix an oracle body with the view definitions it needs."""
    body = body.strip()
    local = re.findall(r"(\w+) AS (?:MATERIALIZED )?\(", body) if body.upper().startswith("WITH") else []
    names = [n for n in VIEWS if n not in local]
    ctes = [f"{n} AS ({_dialect(VIEWS[n], _DUCK)})" for n in _needed(body, names)]
    if not ctes:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        rest = body[len("WITH RECURSIVE") if recursive else len("WITH"):].strip()
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + body


# Views that many steps read: written once per session to the checkpoint folder.
STORED = (
    "profile_docs", "repos", "dict_terms", "token_docs", "pair_people", "rules", "role_config", "role_skills",
    "matches", "judgements", "companies_left", "companies_right", "applications", "roles",
)
_kept: dict[tuple[str, str, str], str] = {}


def forget() -> None:
    """Make stored views anew on their next use, as after a change of the files."""
    _kept.clear()


def kept_names() -> list[str]:
    return sorted({name for _, _, name in _kept})


class Inputs:
    """Tables and derived views of one data folder: ``inputs("evals")``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in STORED:
            return self.keep(name, lambda: self.sql(f"SELECT * FROM {name}"))
        return self.sql(f"SELECT * FROM {name}")

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Table written on first use below the checkpoint folder and read from there."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _kept:
            path = f"{ensure_checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
            build().write.parquet(path)
            _kept[key] = path
        return self.spark.read.parquet(_kept[key])

    def tasks(self) -> int:
        """Tasks for joined lines, from the size of their files; nothing is executed."""
        size = int(self("lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return max(self.spark.sparkContext.defaultParallelism, -(-size // LINES_PER_TASK))

    def sql(self, body: str) -> DataFrame:
        forms = VIEWS | SPARK_FORMS | WORD_FORMS
        views = _needed(body, list(forms), forms)
        if any(v in SPARK_FORMS for v in views):
            forms |= {v: form.replace("{tasks}", str(self.tasks())) for v, form in SPARK_FORMS.items()}
        text = body + " " + " ".join(forms[v] for v in views)
        tables = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        ctes = [f"{t} AS (SELECT * FROM parquet.`{self.folder}/{t}.parquet`)" for t in tables]
        ctes += [f"{v} AS ({_dialect(forms[v], _SPARK)})" for v in views]
        return self.spark.sql("WITH " + ",\n".join(ctes) + "\n" + body)
