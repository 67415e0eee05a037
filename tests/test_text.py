"""Text rules on small literal rows."""

import pytest
from pyspark.sql import functions as F

from corpusfit.functions import dates, labels, text
from corpusfit.operators import flags
from corpusfit.sources.readers import json_list_safe


@pytest.fixture()
def one(spark):
    def run(column, *values):
        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([tuple(values)], ", ".join(
            f"{n} {'double' if isinstance(x, float) else 'int' if isinstance(x, int) else 'array<string>' if isinstance(x, list) else 'string'}"
            for n, x in zip(names, values)))
        return df.select(column(*[F.col(n) for n in names]).alias("x")).first().x
    return run


@pytest.mark.parametrize("line,name", [
    ("Asha Verne", "Asha Verne"), ("ASHA VERNE", "Asha Verne"), ("Verne, Asha", "Asha Verne"),
    ("Name: Asha Verne", "Asha Verne"), ("Asha Verne | +1 555 | a@b.example", "Asha Verne"), ("N. V. Verne", "N. V. Verne"),
    ("Software Engineer", None), ("Work Experience", None), ("visit http://x.example", None), ("Asha", None), ("", None),
])
def test_extract_name(one, line, name):
    assert one(text.extract_name, line) == name


def test_name_after_blank_lines(one):
    assert one(text.extract_name, "\n\nResume\nBirger Lund\nEngineer") == "Birger Lund"


@pytest.mark.parametrize("said,year", [
    ("2018 - 2022", 2022), ("2020-22", 2022), ("1998-01", 2001), ("(Aug 2019 – May 2023)", 2023), ("Class of 2021", 2021),
    ("2024 (expected)", 2024), ("B.Tech 2015", 2015), ("1975", None), ("2030", None), ("2019 - present", 2019),
])
def test_graduation_year(one, said, year):
    assert one(lambda c: text.graduation_year(c, F.lit(""), 2024), said) == year


def test_degree_line_looks_ahead_until_heading(one):
    raw = "Bachelor of Science\nSome school\n2012 - 2016\nWork experience\n2016 - 2020"
    assert one(lambda c: text.graduation_year(F.lit(None).cast("string"), c, 2024), raw) == 2016


def test_year_ranges_and_internships(one):
    got = one(lambda c: text.year_ranges(c, 2024), "Engineer\nJan 2018 – Mar 2020\nIntern at X\n2016 - 2017\n05/2021 - present\n2022 - 2020")
    assert [(s.start_year, s.end_year, s.intern) for s in got] == [(2018, 2020, False), (2016, 2017, True), (2021, 2024, True)]


def test_years_union_touching_spans(one):
    assert one(lambda c: text.years_of_experience(c, F.lit(""), 2024), "2010 - 2012\n2012 - 2015\n2014 - 2016\n2020 - 2021") == 7.0
    assert one(lambda c: text.years_of_experience(F.lit(""), c, 2024), "over 6+ years of work") == 6.0


def test_contacts(one):
    assert one(text.extract_email, "x " * 3000 + "Write Me@Example.ORG now") == "me@example.org"
    assert one(text.extract_phone, "in 2019 call +1 555-010-9999 or not") == "+1 555-010-9999"
    assert one(text.extract_phone, "id 12345") is None
    assert one(text.job_ref, "Re: [JOB-42] hello") == 42 and one(text.job_ref, "job_id: 7") == 7 and one(text.job_ref, "none") is None
    assert one(text.url_username, "https://github.com/some-one/repo") == "some-one"
    assert one(text.url_username, "some-one") == "some-one" and one(text.url_username, "-bad-") is None
    assert one(text.canonical_profile_url, "linkedin.com/in/abc/") == "https://www.linkedin.com/in/abc"
    assert one(text.scrub_pii, "a@b.example or +1 (555) 010-9999") == "<EMAIL_ADDRESS> or <PHONE_NUMBER>"
    assert one(text.blind_email, "someone@x.example") == "so***@***.***"


def test_months(one):
    assert one(dates.month_text, "Jan 2020") == "2020-01" and one(dates.month_text, "2020") == "2020-01"
    assert one(dates.month_text, "present") is None and one(dates.month_gap, "2020-01", "2019-10") == 3


def test_page_rules(one):
    html = ('<title>A &amp; B</title><meta content="About &lt;us&gt;" name="description"><script>x</script>'
            "<h2>Big <b>Project</b></h2><h3>no</h3><p>Body</p>")
    meta = one(text.page_meta, html)
    assert meta.title == "A & B" and meta.description == "About <us>"
    assert one(text.page_headings, html) == ["Big Project"]
    assert one(text.page_text, html).endswith("Body") and "x" not in one(text.page_text, html).split()


def test_skill_tiers(one):
    assert one(lambda t: text.kw_tier(F.lit("Kubernetes"), t), "runs k8s daily") == 1.0
    assert one(lambda t: text.kw_tier(F.lit("machine vision systems"), t), "vision for a machine in systems") == 0.85
    assert one(lambda t: text.kw_tier(F.lit("data platform design"), t), "the data shop") == 0.35
    assert one(lambda t: text.kw_tier(F.lit("Rust"), t), "python") == 0.0
    assert one(lambda t: text.tenure_years(F.lit("C++"), t, 2024), "C++ (2019-present) ") == 5.0
    assert one(lambda t: text.tenure_years(F.lit("React"), t, 2024), "3+ years of React") == 3.0
    assert one(lambda t: text.recency_factor(t, 2024), "2001 - 2010") == 0.55 and one(lambda t: text.recency_factor(t, 2024), "none") == 1.0
    assert one(lambda t: text.complexity_factor(t, F.lit(False)), "docker, aws and kafka in production") == 1.25
    assert one(lambda t: text.complexity_factor(t, F.lit(True)), "coursework; designed it") == pytest.approx(0.92)


def test_education(one):
    majors = F.array(F.lit("Computer Science"))
    assert one(lambda t: text.edu_score(t, F.lit("master"), majors), "bachelor, computer science, university, gpa") == pytest.approx(0.55)
    assert one(lambda t: text.edu_level(t, F.lit("phd")), "bachelor") == pytest.approx(0.15)


def test_labels(one):
    assert [one(lambda c: labels.fit_band(c), x) for x in (0.0, 49.9, 50.0, 75.0, 100.0)] == ["weak", "weak", "moderate", "strong", "strong"]
    assert one(lambda c: labels.level_from_years(c, F.lit(None).cast("int"), F.lit("x"), 2024), 10.0) == "executive"
    assert one(lambda c: labels.level_from_years(c, F.lit(2023), F.lit("x"), 2024), 10.0) == "entry"
    assert one(lambda c: labels.experience_match(c, F.lit(0)), 0.0) == 1.0


def test_json_lists(one):
    assert one(json_list_safe, '["a","b"]') == ["a", "b"]
    assert one(json_list_safe, '{"a":1}') == [] and one(json_list_safe, '["a') == [] and one(json_list_safe, None) == []


def test_flag_notes(spark):
    rows = [("date_mismatch", "experience.Acme.end_date", "2020-01", "2020-03"), ("company_mismatch", "experience", "A", "B"),
            ("github_skill_gap", "github.skills", "x, y", None)]
    got = flags.flag_severity(spark.createDataFrame(rows, "flag_type string, field string, left_value string, right_value string")).collect()
    assert [r.severity for r in got] == ["low", "high", "medium"]
    assert got[0].note == "The public profile gives end date of Acme as 2020-03, the document says 2020-01."
    assert "2 listed skills: x, y" in got[2].note


def test_interview_questions_are_five(one):
    assert len(one(lambda m: text.interview_questions(F.lit("Baker"), m, F.array().cast("array<string>")), ["Spark"])) == 5


def test_a_text_is_rated_once_for_all_its_skills(spark):
    rows = [
        (1, "Designed Spark jobs. Did not use Kafka\nbefore. Learned kafka and go. n", ["spark", "KAFKA", "go", "rust", None]),
        (2, None, ["spark"]), (3, "Works with c++. Uses c++", ["c++", ""]), (4, "", []), (5, "a.b", None)]
    df = spark.createDataFrame(rows, "id int, text string, skills array<string>")
    one_by_one = df.select("id", "text", F.explode("skills").alias("skill")).select(
        "id", "skill", text.confidence_tier(F.col("text"), F.col("skill")).alias("tier"))
    at_once = df.select("id", F.inline(text.confidence_tiers(F.col("text"), F.col("skills"))))
    assert at_once.columns == ["id", "skill", "tier"]
    got = sorted(at_once.collect(), key=str)
    assert got == sorted(one_by_one.collect(), key=str) and len(got) == 8
    assert {(r.id, r.skill): r.tier for r in got}[1, "spark"] == 1.2
    # The query's join has a row per document, not a copy of its text per skill.
    from corpusfit import catalog

    catalog.load_all()
    plan = catalog.QUERIES["confidence_tier"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("SortMergeJoin") and "Generate" not in plan[plan.index("SortMergeJoin"):]
