"""Text-rule queries. Fixed patterns are shared with the twins; the logic around them is not."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfit.catalog.registry import query
from corpusfit.functions import dates, labels, lists, text
from corpusfit.operators import dictionary, flags, joins, page_profile, topk
from corpusfit.scale import by_shuffle

C = F.col
YEAR = 2002
PUNCT = "[!-/:-@\\[-`{-~]"


def q(pattern: str) -> str:
    """Pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query("norm_fingerprint", rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), {q(PUNCT)}, '', 'g'), '\s+', ' ', 'g')) AS norm FROM documents""")
def _(v):
    return v("documents").select("doc_id", text.norm_fingerprint(C("text")).alias("norm"))


@query("norm_tech", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s+#.\-]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents""")
def _(v):
    return v("documents").select("doc_id", text.norm_tech(C("text")).alias("norm"))


@query("norm_name", r"""SELECT candidate_id, CASE WHEN email IS NOT NULL THEN
      array_to_string(list_transform(string_split(regexp_replace(string_split(email, '@')[1], '[._\-]', ' ', 'g'), ' '),
        lambda w: upper(w[1:1]) || lower(w[2:])), ' ')
    ELSE upper(title[1:1]) || lower(title[2:]) || ' Okoro' END AS shown_name FROM candidates""")
def _(v):
    file_name = F.concat(F.lower("title"), F.lit("-okoro_Resume_2.pdf"))
    return v("candidates").select("candidate_id", text.salvage_name(C("email"), file_name).alias("shown_name"))


@query("extract_email", f"""SELECT doc_id, lower(nullif(regexp_extract(text, {q(lists.EMAIL_PATTERN)}), '')) AS email FROM documents""")
def _(v):
    return v("documents").select("doc_id", text.extract_email(C("text")).alias("email"))


@query("extract_phone", rf"""SELECT doc_id, {strip(rf"list_filter(regexp_extract_all(text, {q(lists.PHONE_PATTERN)}), lambda p: length(regexp_replace(p, '\D', '', 'g')) BETWEEN 7 AND 15)[1]")} AS phone FROM documents""")
def _(v):
    return v("documents").select("doc_id", text.extract_phone(C("text")).alias("phone"))


@query("extract_links", r"""WITH body AS (SELECT page_id, url || ' https://www.github.com/team' || page_id || '/x ' || url || ' http://linkedin.com/in/p-' || page_id AS t FROM pages)
  SELECT page_id, nullif(regexp_extract(t, '(?i)https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9\-_%]+/?'), '') AS profile_url,
    nullif(regexp_extract(t, '(?i)https?://(?:www\.)?github\.com/[a-zA-Z0-9\-_%]+(?:/[^\s"''<>]*)?'), '') AS code_url,
    list_filter(regexp_extract_all(t, '(?i)https?://[a-zA-Z0-9\-]+\.[a-zA-Z]{2,}(?:/[^\s"''<>]*)?'),
      lambda u: NOT regexp_matches(u, '(?i)^https?://(?:www\.)?(?:linkedin|github)\.com') AND NOT regexp_matches(u, '(?i)^https?://www\.(github|linkedin)$'))[1] AS other_url
  FROM body""")
def _(v):
    body = F.concat(
        C("url"), F.lit(" https://www.github.com/team"), C("page_id").cast("string"), F.lit("/x "), C("url"),
        F.lit(" http://linkedin.com/in/p-"), C("page_id").cast("string"))
    return v("pages").select("page_id", text.extract_links(body).alias("l")).select("page_id", "l.*")


@query("job_ref", """SELECT conv_id, turn, conv_id AS job_id FROM mail WHERE conv_id IS NOT NULL""")
def _(v):
    subject = F.concat(F.substring("subject", 1, 1), F.when(C("conv_id") % 2 == 0, " [JOB-").otherwise(" job_id: "),
                       C("conv_id").cast("string"), F.lit("] "), C("subject"))
    return v("mail").select("conv_id", "turn", text.job_ref(subject).cast("long").alias("job_id"))


@query("extract_name", "SELECT owner AS doc_id, first_name || ' ' || last_name AS name FROM profile_names")
def _(v):
    return v("profile_docs").select("doc_id", text.extract_name(C("text")).alias("name"))


@query("plausible_name", """SELECT owner, first_name <> 'Machinery' AS plausible FROM profile_names""")
def _(v):
    blocked = (*lists.NOT_NAME_WORDS, "machinery")
    return v("profile_names").select(
        "owner", text.plausible_name(F.concat_ws(" ", "first_name", "last_name"), blocked).alias("plausible"))


JOBS = """SELECT owner, coalesce(jobs, '') AS jobs FROM profile_names LEFT JOIN profile_jobs USING (owner)"""


@query("extract_title", rf"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}),
    lambda x: length(x) BETWEEN 4 AND 120 AND NOT regexp_matches(x, '^[\d\s\-/,–—|•]+$')
      AND (list_has_any(string_split_regex(lower(x), '\s+'), {list(lists.TITLE_WORDS)})
        OR len(string_split_regex(x, '\s+')) BETWEEN 2 AND 7))[1] AS title FROM documents""")
def _(v):
    return v("documents").select("doc_id", text.extract_title(C("text")).alias("title"))


PIECES = rf"""jobs AS ({JOBS}), cut AS (SELECT owner, string_split_regex(jobs, {q(lists.YEAR_RANGE_PATTERN)}) AS pieces,
      regexp_extract_all(jobs, {q(lists.YEAR_RANGE_PATTERN)}) AS whole,
      regexp_extract_all(jobs, {q(lists.YEAR_RANGE_PATTERN)}, 1) AS s, regexp_extract_all(jobs, {q(lists.YEAR_RANGE_PATTERN)}, 2) AS e FROM jobs),
    spans AS (SELECT owner, i, CAST(s[i] AS INT) AS start_year, CAST(regexp_extract(e[i], '\d{{4}}') AS INT) AS end_year,
      array_to_string(list_transform(range(1, i + 1), lambda j: pieces[j] || CASE WHEN j < i THEN whole[j] ELSE '' END), '') AS ctx
      FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM cut)),
    flagged AS (SELECT *, regexp_matches(array_to_string(list_filter(list_transform(string_split(ctx, chr(10)), lambda x: trim(x)), lambda x: x <> '')[-5:], chr(10)),
      {q(lists.INTERN_PATTERN)}) AS intern FROM spans),
    ok AS (SELECT * FROM flagged WHERE start_year BETWEEN 1970 AND 2002 AND end_year BETWEEN start_year AND 2003)"""


def _job_spans(v):
    return v.sql(JOBS).select("owner", F.posexplode(text.year_ranges(C("jobs"), YEAR)).alias("pos", "span"))


@query("year_ranges", f"WITH {PIECES} SELECT owner, start_year, end_year FROM ok")
def _(v):
    return _job_spans(v).select("owner", "span.start_year", "span.end_year")


@query("intern_context", f"WITH {PIECES} SELECT owner, start_year, end_year, intern FROM ok")
def _(v):
    return _job_spans(v).select("owner", "span.*")


@query("years_of_experience", f"""WITH {PIECES}, y AS (SELECT DISTINCT owner, unnest(range(start_year, end_year)) AS yr FROM ok WHERE NOT intern)
  SELECT n.owner, CASE WHEN EXISTS (SELECT 1 FROM ok WHERE ok.owner = n.owner AND NOT intern)
    THEN CAST((SELECT count(*) FROM y WHERE y.owner = n.owner) AS DOUBLE) ELSE CAST(n.owner % 40 + 1 AS DOUBLE) END AS years FROM profile_names n""")
def _(v):
    stated = F.concat(F.lit("over "), (C("owner") % 40 + 1).cast("string"), F.lit("+ years in shops"))
    # Dealt out by the size of the lines' table: the joined texts are few bytes, but much work each.
    jobs = v.sql(JOBS).repartition(v.tasks(), "owner")
    return jobs.select("owner", text.years_of_experience(C("jobs"), stated, YEAR).alias("years"))


@query("years_phrase", """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 61 BETWEEN 1 AND 49
    THEN CAST((conv_id + turn) % 61 AS DOUBLE) END AS years FROM mail""")
def _(v):
    said = F.concat(C("subject"), F.lit(" with more than "), ((C("conv_id") + C("turn")) % 61).cast("string"), F.lit("+ years"))
    return v("mail").select("conv_id", "turn", text.years_phrase(said).alias("years"))


@query("graduation_year", """SELECT owner AS doc_id, CAST(1990 + owner % 13 AS INT) AS graduation_year FROM profile_names""")
def _(v):
    edu = F.element_at(F.split("text", "Education:\n"), -1)
    return v("profile_docs").select("doc_id", text.graduation_year(edu, C("text"), YEAR).alias("graduation_year"))


@query("graduation_forms", """SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN 1996 + c_custkey % 9 WHEN 1 THEN 1995 + c_custkey % 8
    WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 2001 ELSE 1999 END ELSE 1989 + c_custkey % 7 END AS INT) AS graduation_year FROM customer""")
def _(v):
    k = C("c_custkey")
    said = (
        F.when(k % 4 == 0, F.concat(F.lit("Class of "), (k % 9 + 1996).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("("), (k % 8 + 1991).cast("string"), F.lit(" - May "), (k % 8 + 1995).cast("string"), F.lit(")")))
        .when(k % 4 == 2, F.when(k % 3 == 0, "1998-01").otherwise("1995-99"))
        .otherwise(F.concat((k % 7 + 1989).cast("string"), F.lit(" (expected), minor 1979"))))
    return v("customer").select("c_custkey", text.graduation_year(said, F.lit(""), YEAR).alias("graduation_year"))


@query("degree_lookahead", rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM profile_docs),
    ix AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l),
    deg AS (SELECT *, list_filter(range(i + 1, least(i + 5, len(ls)) + 1), lambda j: regexp_matches(lower(ls[j]), '{"|".join(lists.OTHER_HEADING_WORDS)}'))[1] AS halt
      FROM ix WHERE regexp_matches(ls[i], {q(lists.DEGREE_LINE_PATTERN)}))
  SELECT doc_id, array_to_string(flatten(list(ls[i:least(coalesce(halt - 1, i + 5), i + 5, len(ls))] ORDER BY i)), ' / ') AS near_degree FROM deg GROUP BY doc_id""")
def _(v):
    near = text.degree_lines(C("text"))
    return v("profile_docs").select("doc_id", F.array_join(near, " / ").alias("near_degree")).filter("near_degree <> ''")


@query("level_from_years", """SELECT c_custkey, CASE WHEN 1985 + c_custkey % 18 >= 2001 THEN 'entry' WHEN c_custkey % 11 = 0 THEN 'mid-text'
    WHEN c_custkey % 14 < 1 THEN 'entry' WHEN c_custkey % 14 < 3 THEN 'junior' WHEN c_custkey % 14 < 5 THEN 'mid'
    WHEN c_custkey % 14 < 10 THEN 'senior' ELSE 'executive' END AS level FROM customer""")
def _(v):
    k = C("c_custkey")
    years = F.when(k % 11 != 0, (k % 14).cast("double"))
    return v("customer").select(
        "c_custkey", labels.level_from_years(years, k % 18 + 1985, F.lit("mid-text"), YEAR).alias("level"))


@query("level_from_text", f"""SELECT doc_id, CASE WHEN regexp_matches(text, {q(lists.ENTRY_PATTERN)}) THEN 'entry'
    WHEN regexp_matches(text, {q(lists.JUNIOR_PATTERN)}) THEN 'junior' WHEN regexp_matches(text, {q(lists.EXECUTIVE_PATTERN)}) THEN 'executive'
    WHEN regexp_matches(text, {q(lists.SENIOR_PATTERN)}) THEN 'senior' ELSE 'entry' END AS level
  FROM (SELECT doc_id, replace(text, 'EXPERIENCE', CASE doc_id % 3 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Jr. role' ELSE 'Vice president' END) AS text FROM profile_docs)""")
def _(v):
    word = F.when(C("doc_id") % 3 == 0, "Senior").when(C("doc_id") % 3 == 1, "Jr. role").otherwise("Vice president")
    return v("profile_docs").select(
        "doc_id", text.level_from_text(F.replace(C("text"), F.lit("EXPERIENCE"), word)).alias("level"))


@query("is_fresher", """SELECT candidate_id, role_id = 1 OR level IN ('entry', 'intern') OR coalesce(graduation_year >= 2001, false) AS fresher
  FROM candidates JOIN applications ON doc_id = candidate_id""")
def _(v):
    rows = v("candidates").join(v("applications"), C("candidate_id") == C("doc_id"))
    return rows.select("candidate_id", labels.is_fresher(C("role_id") == 1, C("level"), C("graduation_year"), YEAR).alias("fresher"))


@query("experience_match", """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 1.0E0 WHEN (c_custkey % 13) / (c_custkey % 6) >= 1 THEN 1.0E0
    WHEN (c_custkey % 13) / (c_custkey % 6) >= 0.75 THEN 0.8E0 WHEN (c_custkey % 13) / (c_custkey % 6) >= 0.5 THEN 0.55E0 ELSE 0.2E0 END AS fit FROM customer""")
def _(v):
    k = C("c_custkey")
    return v("customer").select("c_custkey", labels.experience_match((k % 13).cast("double"), k % 6).alias("fit"))


SKILL_WORDS = "list_filter(string_split_regex(lower(skill), '\\s+'), lambda w: length(w) > 2)"


@query("kw_tier", rf"""WITH p AS (SELECT doc_id, lower(text) AS t, skill, {SKILL_WORDS} AS words FROM profile_docs
      JOIN applications USING (doc_id) JOIN role_skills USING (role_id)),
    h AS (SELECT *, len(list_filter(words, lambda w: contains(t, w))) AS hits FROM p)
  SELECT doc_id, skill, CAST(CASE WHEN contains(t, skill) THEN 1.0 WHEN len(words) < 2 THEN 0 WHEN hits = len(words) THEN 0.85
    WHEN hits >= len(words) * 0.7 THEN 0.6 WHEN hits > 0 THEN 0.35 ELSE 0 END AS DOUBLE) AS tier FROM h""")
def _(v):
    rows = v("profile_docs").join(v("applications"), "doc_id").join(v("role_skills"), "role_id")
    return rows.select("doc_id", "skill", text.kw_tier(C("skill"), C("text")).alias("tier"))


@query("recency_factor", rf"""WITH y AS (SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(text, {q(lists.RECENCY_PATTERN)}, 1), lambda x: TRY_CAST(x AS INT)),
      lambda y: y BETWEEN 1970 AND 2006)) AS newest FROM profile_docs)
  SELECT doc_id, CAST(CASE WHEN newest IS NULL OR 2005 - newest <= 2 THEN 1.0 WHEN 2005 - newest <= 5 THEN 0.85
    WHEN 2005 - newest <= 10 THEN 0.7 ELSE 0.55 END AS DOUBLE) AS factor FROM y""")
def _(v):
    return v("profile_docs").select("doc_id", text.recency_factor(C("text"), 2005).alias("factor"))


@query("complexity_factor", f"""WITH n AS (SELECT doc_id, text, len(regexp_extract_all(text, {q(lists.PRODUCTION_PATTERN)})) AS p, len(regexp_extract_all(text, {q(lists.ACADEMIC_PATTERN)})) AS a FROM profile_docs),
    b AS (SELECT doc_id, text, CAST(CASE WHEN p >= 3 THEN 1.25 WHEN p >= 1 AND a = 0 THEN 1.1 WHEN a >= 2 AND p = 0 THEN 0.7 WHEN a >= 1 AND p = 0 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS base FROM n)
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND regexp_matches(text, {q(lists.DESIGN_PATTERN)}) THEN least(base * 1.15E0, 1.25E0) ELSE base END AS factor FROM b""")
def _(v):
    return v("profile_docs").select(
        "doc_id", text.complexity_factor(C("text"), C("doc_id") % 2 == 0).alias("factor"))


@query("tenure_years", r"""SELECT doc_id, skill, CAST(coalesce(nullif(regexp_extract(t, '(\d+)\+?\s*years?\s+(?:of\s+)?(?:\w+\s+)?' || skill, 1), ''),
    nullif(regexp_extract(t, skill || '[^\n\.]{0,60}?(\d+)\+?\s*years?', 1), '')) AS DOUBLE) AS years
  FROM (SELECT doc_id, lower(text) AS t FROM profile_docs), (SELECT skill FROM skills) WHERE contains(t, skill)
    AND (SELECT count(*) FROM repos WHERE owner = doc_id AND name = skill) + CASE WHEN skill = 'red widget' AND doc_id % 5 = 0 THEN 1 ELSE 0 END > 0""")
def _(v):
    owned = v.sql("SELECT owner AS doc_id, collect_list(name) AS owned FROM owned_names GROUP BY owner")
    docs = v("profile_docs").select("doc_id", F.lower("text").alias("lower"), text.tenure_text(C("text")).alias("years_in"))
    listed = F.coalesce("owned", F.array().cast("array<string>"))
    rows = docs.join(owned, "doc_id", "left").withColumn(
        "skills", F.when(C("doc_id") % 5 == 0, F.array_union(listed, F.array(F.lit("red widget")))).otherwise(listed))
    longest = F.array_max(F.transform("skills", lambda s: F.length(F.lower(s))))
    found = text.bound(text.tenure_near(C("years_in"), longest), lambda near: F.transform(
        F.filter("skills", lambda s: F.contains(C("lower"), F.lower(s))),
        lambda s: F.struct(s.alias("skill"), text.tenure_in(F.lower(s), near, YEAR).alias("years"))))
    return rows.select("doc_id", F.inline(found))


EDU = ", ".join(f"'{w}'" for w in lists.EDUCATION_WORDS)


@query("edu_score", rf"""WITH e AS (SELECT d.doc_id, r.role_id, lower(text) AS t, min_degree, preferred_majors IS NOT NULL AS has_majors
      FROM profile_docs d JOIN applications a ON a.doc_id = d.doc_id JOIN roles r ON r.role_id = a.role_id)
  SELECT doc_id, role_id, round_even(least(len(list_filter([{EDU}], lambda w: contains(t, w))) / 4, 1.0)
      * CASE WHEN min_degree = 'master' THEN 0.55 ELSE 1.0 END
      * CASE WHEN NOT has_majors THEN 1.0 ELSE 0.5 END, 6) AS score FROM e""")
def _(v):
    rows = v("profile_docs").join(v("applications"), "doc_id").join(v("roles"), "role_id")
    majors = F.transform(F.split("preferred_majors", ","), text.strip)
    return rows.select("doc_id", "role_id", F.bround(text.edu_score(C("text"), C("min_degree"), majors), 6).alias("score"))


@query("best_excerpt", rf"""WITH s AS (SELECT doc_id, term, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: {strip('x')}), lambda x: length(x) > 15) AS ls
      FROM documents JOIN token_docs USING (doc_id) JOIN dict_terms ON term = token)
  SELECT doc_id, term, list_filter(ls, lambda x: contains(lower(x), term))[1] AS excerpt FROM s""")
def _(v):
    hits = v("token_docs").join(v("dict_terms"), C("token") == C("term")).select("doc_id", "term")
    return topk.best_excerpts(v("documents").select("doc_id", "text"), hits)


@query("manifest_deps", """SELECT DISTINCT owner, repo_id, replace(name, ' ', '-') AS dependency FROM repos
  UNION SELECT owner, repo_id, 'lib' || stars FROM repos WHERE repo_id % 4 = 0""")
def _(v):
    name, k = F.replace(C("name"), F.lit(" "), F.lit("-")), C("repo_id") % 4
    file_name = F.when(k == 0, "requirements.txt").when(k == 1, "package.json").when(k == 2, "go.mod").otherwise("pyproject.toml")
    content = (
        F.when(k == 0, F.concat(F.lit("# deps\n-r base.txt\npytest==8\n"), name, F.lit(">=1.0\nlib"), C("stars").cast("string"), F.lit(" ; x\n")))
        .when(k == 1, F.concat(F.lit('{"dependencies": {"'), name, F.lit('": "1"}, "devDependencies": {"jest": "2"}}')))
        .when(k == 2, F.concat(F.lit("module m\nrequire (\n\texample.com/x/"), name, F.lit(" v1.2.3\n)")))
        .otherwise(F.concat(F.lit('[project]\ndependencies = ["'), name, F.lit('>=2", "black>=1"]'))))
    return flags.manifest_deps(v("repos").select("owner", "repo_id", file_name.alias("file_name"), content.alias("content")))


@query("url_username", r"""SELECT page_id, nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*/+([^/]+)', 1), '') AS user_name FROM pages""")
def _(v):
    return v("pages").select("page_id", text.url_username(C("url")).alias("user_name"))


@query("canonical_profile_url", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.linkedin.com/in/p' || page_id END AS profile FROM pages""")
def _(v):
    k = C("page_id").cast("string")
    raw = F.when(C("page_id") % 3 == 0, F.concat(F.lit(" m.linkedin.com/in/p"), k, F.lit("/?ref=x"))).when(
        C("page_id") % 3 == 1, F.concat(F.lit("https://linkedin.com/company/"), k)).otherwise(C("url"))
    return v("pages").select("page_id", text.canonical_profile_url(raw).alias("profile"))


@query("month_text", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y-01')
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders""")
def _(v):
    d, k = C("o_orderdate"), C("o_orderkey") % 4
    raw = F.when(k == 0, " Present ").when(k == 1, F.date_format(d, "yyyy")).when(
        k == 2, F.date_format(d, "MMM yyyy")).otherwise(F.date_format(d, "MMMM yyyy"))
    return v("orders").select("o_orderkey", dates.month_text(raw).alias("month"))


def tags(x: str) -> str:
    bare = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, char in text.ENTITIES:
        bare = f"replace({bare}, {q(entity)}, {q(char)})"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


PAGE = tags(r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')")


@query("page_text", f"SELECT page_id, {PAGE} AS plain FROM pages")
def _(v):
    return v("pages").select("page_id", text.page_text(C("html")).alias("plain"))


@query("page_meta", rf"""SELECT page_id, {tags("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
    {PAGE} AS description FROM pages""")
def _(v):
    return v("pages").select("page_id", text.page_meta(C("html")).alias("m")).select("page_id", "m.*")


ENTRY = r"regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href=\"/[^\"]*\">([^<]*)</a></li>', 1)"


@query("profile_from_page", rf"""WITH p AS (SELECT page_id, list_transform({ENTRY}, lambda x: {tags('x')}) AS links, {tags("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages),
    l AS (SELECT page_id, unnest(links) AS name, unnest(range(len(links))) AS position FROM p)
  SELECT page_id, 'experience' AS kind, position, name, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS VARCHAR) AS start_month, CAST(NULL AS VARCHAR) AS end_month FROM l WHERE name <> ''
  UNION ALL SELECT page_id, 'skill', min(position), arg_min(name, position), NULL, NULL, NULL FROM l WHERE length(name) BETWEEN 1 AND 99 GROUP BY page_id, lower(name)
  UNION ALL SELECT page_id, 'education', 0, CASE WHEN links[1] <> '' THEN links[1] END, nullif(title, ''), '1999-01', '2000-03' FROM p WHERE links[1] <> ''
  UNION ALL SELECT page_id, 'education', 1, links[1], NULL, NULL, NULL FROM p WHERE links[1] <> ''
  UNION ALL SELECT page_id, 'education', 2, nullif(title, ''), NULL, NULL, NULL FROM p WHERE title <> ''""")
def _(v):
    """Links of the pages' menus stand for work entries and pills; a record with a nested list, told by its id, follows the page."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    menu = F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1)
    first = F.regexp_extract(menu, '<li><a href="/[^"]*">([^<]*)</a></li>', 1)
    html = F.regexp_replace(
        F.regexp_replace("html", "(?s)<nav>(.*?)</nav>", "<section><h2>Work History</h2>$1</section>"),
        '<li>(<a) (href="/[^"]*">[^<]*</a>)</li>', '<li><h3>$1 class="endorsement-pill" $2</h3></li>')
    record = F.concat(
        F.lit('<div id="my-academic-record"><ul><li><h3>Outer</h3><h4>'), title, F.lit('</h4><ul><li><span class="school">'), first,
        F.lit('</span></li></ul><span class="date">1999</span><span class="date">Mar 2000</span></li><li><h3>'), title, F.lit("</h3></li></ul></div>"))
    return page_profile.profile_from_page(v("pages").select("page_id", F.concat(html, record).alias("html")))


@query("page_headings", rf"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-4][^>]*>(.*?)</h[1-4]>', 1),
    lambda h: {tags('h')}), lambda h: length(h) BETWEEN 5 AND 199), ' | ') AS headings FROM pages""")
def _(v):
    return v("pages").select("page_id", F.array_join(text.page_headings(C("html")), " | ").alias("headings"))


@query("page_tech", rf"""SELECT page_id, term FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(lower({PAGE}), '[\p{{L}}\p{{N}}_]+'))) AS token FROM pages) p
    JOIN dict_terms ON term = token""")
def _(v):
    plain = v("pages").select(C("page_id").alias("text_id"), text.page_text(C("html")).alias("text"))
    found = dictionary.dictionary_match(plain, v("dict_terms").select("term"), mode="token")
    return found.select(C("text_id").alias("page_id"), "term")


@query("jd_skills", """SELECT item_id, term AS skill FROM benchmark JOIN dict_terms ON regexp_matches(lower(text), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')
  UNION SELECT item_id, 'tion family' FROM benchmark WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(attion|sttion)([^a-z0-9]|$)')""")
def _(v):
    alias = v.spark.createDataFrame([("attion", "tion family"), ("sttion", "tion family")], "term string, skill string")
    known = v("dict_terms").select("term", C("term").alias("skill")).unionByName(alias)
    found = dictionary.jd_skills(v("benchmark").select(C("item_id").alias("text_id"), "text"), known)
    return found.select(C("text_id").alias("item_id"), "skill")


@query("scrub_pii", rf"""SELECT doc_id, regexp_replace(regexp_replace(text, {q(lists.EMAIL_PATTERN)}, '<EMAIL_ADDRESS>', 'g'),
    {q(text.PHONE_RUN)}, '<PHONE_NUMBER>', 'g') AS clean FROM documents""")
def _(v):
    return v("documents").select("doc_id", text.scrub_pii(C("text")).alias("clean"))


@query("blind_mask", """SELECT candidate_id, 'Candidate #' || row_number() OVER (ORDER BY years_experience DESC NULLS LAST, candidate_id) AS shown_name,
    substr(string_split(email, '@')[1], 1, 2) || '***@***.***' AS shown_email FROM candidates""")
def _(v):
    from corpusfit.operators.windows import global_rank

    ranked = global_rank(v("candidates"), [C("years_experience").desc_nulls_last(), C("candidate_id")])
    return ranked.select(
        "candidate_id", text.blind_name(C("rank")).alias("shown_name"), text.blind_email(C("email")).alias("shown_email"))


FLAGS = """both_sides AS (
    SELECT coalesce(a.owner, b.owner) AS owner, a.company AS l_name, a.end_month AS l_end, b.company AS r_name, b.end_month AS r_end,
      abs((CAST(substr(a.end_month, 1, 4) AS INT) * 12 + CAST(substr(a.end_month, 6, 2) AS INT))
        - (CAST(substr(b.end_month, 1, 4) AS INT) * 12 + CAST(substr(b.end_month, 6, 2) AS INT))) AS gap
    FROM companies_left a FULL JOIN companies_right b ON a.owner = b.owner AND lower(a.company) = lower(b.company))"""


@query("flag_severity", f"""WITH {FLAGS} SELECT owner, 'date_mismatch' AS flag_type, 'medium' AS severity,
      'The public profile gives end date of ' || l_name || ' as ' || r_end || ', the document says ' || l_end || '.' AS note FROM both_sides WHERE gap > 3
    UNION ALL SELECT owner, 'missing_entry', 'medium', 'The document names ' || l_name || ', the public profile does not.' FROM both_sides WHERE r_name IS NULL
    UNION ALL SELECT owner, 'missing_entry', 'medium', 'The public profile names ' || r_name || ', the document does not.' FROM both_sides WHERE l_name IS NULL""")
def _(v):
    found = joins.reconcile_sources(v("companies_left"), v("companies_right"))[1]
    return flags.flag_severity(found).select("owner", "flag_type", "severity", "note")


@query("needs_review", f"""WITH {FLAGS} SELECT owner, bool_or(gap IS NULL AND l_name IS NOT NULL AND length(l_name) % 2 = 0) AS needs_review
  FROM both_sides WHERE gap > 3 OR r_name IS NULL OR l_name IS NULL GROUP BY owner""")
def _(v):
    """Missing entries of companies with names of even length are filed as different company names, which is severe."""
    found = joins.reconcile_sources(v("companies_left"), v("companies_right"))[1]
    other = (C("flag_type") == "missing_entry") & C("left_value").isNotNull() & (F.length("left_value") % 2 == 0)
    found = found.withColumn("flag_type", F.when(other, "company_mismatch").otherwise(C("flag_type")))
    return flags.needs_review(flags.flag_severity(found))


WORDED = """g AS (SELECT e.evaluation_id, list(s.skill ORDER BY s.skill) AS gaps FROM evals e JOIN role_skills s ON s.role_id = e.role_id
      WHERE NOT EXISTS (SELECT 1 FROM matches x WHERE x.evaluation_id = e.evaluation_id AND x.skill = s.skill) GROUP BY 1),
    m AS (SELECT evaluation_id, list(skill ORDER BY skill) AS found FROM matches GROUP BY 1),
    w AS (SELECT e.*, r.title AS job, coalesce(found, []) AS found, coalesce(gaps, []) AS gaps FROM evals e
      JOIN roles r ON r.role_id = e.role_id LEFT JOIN m USING (evaluation_id) LEFT JOIN g USING (evaluation_id))"""


def _worded(v):
    gaps = joins.skill_gaps(v("evals"), v("role_skills"), v("matches")).groupBy("evaluation_id").agg(
        F.array_sort(F.collect_set("skill")).alias("gaps"))
    found = v("matches").groupBy("evaluation_id").agg(F.array_sort(F.collect_set("skill")).alias("found"))
    none = F.array().cast("array<string>")
    return (
        v("evals").join(v("roles").select("role_id", C("title").alias("job")), "role_id")
        .join(found, "evaluation_id", "left").join(gaps, "evaluation_id", "left")
        .withColumn("found", F.coalesce("found", none)).withColumn("gaps", F.coalesce("gaps", none)))


@query("fit_summary", f"""WITH {WORDED} SELECT evaluation_id, concat_ws(' ',
    'The candidate, for ' || job || ': ' || CASE WHEN total_score >= 75 THEN 'strong' WHEN total_score >= 50 THEN 'moderate' ELSE 'weak' END
      || ' match, ' || CAST(round_even(total_score, 0) AS INT) || '% in all.',
    CASE WHEN len(found) > 0 THEN 'Found skills: ' || array_to_string(found[1:5], ', ') || CASE WHEN len(found) > 5 THEN ' and more' ELSE '' END || '.' END,
    CASE WHEN len(gaps) > 0 THEN 'Missing skills: ' || array_to_string(gaps[1:3], ', ') || CASE WHEN len(gaps) > 3 THEN ' and more' ELSE '' END || '.' END,
    CASE WHEN skill_score >= 70 THEN 'Work described is close to the role text (' || CAST(round_even(skill_score, 0) AS INT) || '%).'
      WHEN skill_score > 0 AND skill_score < 35 THEN 'Work described is far from the role text ('
        || CAST(round_even(skill_score, 0) AS INT) || '%).' END,
    CASE WHEN education_score < 30 THEN 'Little or no education was found.'
      WHEN education_score >= 80 THEN 'Education scores high.' END) AS summary FROM w""")
def _(v):
    return _worded(v).select("evaluation_id", text.fit_summary(
        F.lit(""), C("job"), C("total_score"), C("education_score"), C("found"), C("gaps"), C("skill_score")).alias("summary"))


@query("interview_questions", f"""WITH {WORDED} SELECT evaluation_id, array_to_string(list_filter([
    'Where have you met ' || gaps[1] || ' so far, and what would help you to learn it?',
    'For this role you need ' || gaps[2] || '. How have you picked up something similar before?',
    'Which of your projects relied most on ' || found[1] || '? What would you change in it today?',
    'Why the ' || job || ' role, and why now?',
    'Which failure in a running system taught you most?',
    'What did you learn last, and from where?',
    'When did two teams want opposite things from you, and what came of it?'], lambda x: x IS NOT NULL)[1:5], ' ') AS questions FROM w""")
def _(v):
    return _worded(v).select("evaluation_id", F.array_join(
        text.interview_questions(C("job"), C("found"), C("gaps")), " ").alias("questions"))


@query("confidence_tier", """SELECT owner AS doc_id, name AS skill, CASE WHEN owner % 5 = 0
      OR EXISTS (SELECT 1 FROM profile_ranges g WHERE g.owner = r.owner AND range_id % 9 <> 0) THEN 1.0E0 ELSE 0.75E0 END AS tier
  FROM (SELECT DISTINCT owner, name FROM repos) r""")
def _(v):
    listed = v("owned_names").groupBy(C("owner").alias("doc_id")).agg(F.collect_list(F.struct("name")).alias("names"))
    return v("profile_docs").join(by_shuffle(listed), "doc_id").select(
        "doc_id", F.inline(text.confidence_tiers(C("text"), C("names")["name"])))
