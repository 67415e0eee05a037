import random
import re

from pyspark.sql import functions as F

from corpusfit.functions import text
from corpusfit.plans import matching

NAMES = ["react", "c++", "node.js", "machine vision", "s3", "r", "3"]


def years_by_pattern(name, lower, today):
    """The plain rule: patterns made from the name."""
    if name not in lower:
        return None
    quoted = re.escape(name)
    for pattern in (rf"(\d+)\+?\s*years?\s+(?:of\s+)?(?:\w+\s+)?{quoted}", rf"{quoted}[^\n\.]{{0,60}}?(\d+)\+?\s*years?"):
        if "year" in lower and (hit := re.search(pattern, lower)):
            return float(hit[1])
    hit = re.search(rf"{quoted}\s*\((20\d\d|19\d\d)\s*[-–]\s*(20\d\d|19\d\d|present|current)\)", lower)
    if not hit:
        return None
    return float(max(0, (int(hit[2]) if hit[2].isdigit() else today) - int(hit[1])))


def test_years_are_those_of_patterns_made_from_the_name(spark):
    rng = random.Random(7)
    parts = [*NAMES, "unreact", "reactive", "xc++", "of", "solid", "5 years", "12+ years", "1 year", "year", "(2019-2023)", "(2020 – present)",
             "(1999 - 2001)", ".", "\n", "built", "with a long description that goes on", "3years", "42", "é"]
    texts = [rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(1, 14))) if rng.random() < 0.1 else
             " ".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    rows = [(n, t) for t in texts for n in rng.sample(NAMES, 2)]
    got = spark.createDataFrame(rows, "name string, t string").select(
        "name", "t", text.tenure_years(F.col("name"), F.col("t"), 2024).alias("y")).collect()
    wrong = [(r.name, r.t, r.y, years_by_pattern(r.name, r.t, 2024)) for r in got if r.y != years_by_pattern(r.name, r.t, 2024)]
    assert not wrong, wrong[:5]
    assert sum(r.y is not None for r in got) > 1000


def test_years_of_odd_texts(spark):
    def one_year(name, value):
        row = spark.createDataFrame([(name, value)], "name string, t string")
        return row.select(text.tenure_years(F.col("name"), F.col("t"), 2024)).first()[0]

    assert one_year("react", None) is None and one_year("react", "") is None and one_year("", "5 years of it") is None
    assert one_year("react", " 5 years of react") == 5.0
    assert one_year("react", "x " * 200_000 + "7 years of react") == 7.0
    assert one_year("react", "5 years " + "x" * 100_000 + " react " + "1" * 50_000 + " " * 50_000) == 5.0


def test_years_are_those_of_the_whole_text_when_far_parts_are_cut(spark):
    """A text is shortened once for all names, to what is near to stated years; every name finds the same years in it."""
    rng = random.Random(11)
    names = [*NAMES, "years of", " react", "of", "x3", "a name of some length, with a comma"]
    parts = [*names, "unreact", "xc++", "solid", "5 years", "12+ years", "1 year", "3years4yearsabc", "year", "years", "(2019-2023)", "   (2020 – present)",
             "(1999)", ".", "\n", "word " * 9, "z" * 58, "z" * 61, "filler text " * 20, "w" * 200, "42", "7 ", "é" * 70, "٣ years", "\u2003"]
    texts = [rng.choice(["", " ", " "]).join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(4000)]
    rows = [(t, rng.sample(names, 4)) for t in texts]
    longest = F.array_max(F.transform("names", lambda n: F.length(n)))
    near = text.tenure_near(text.tenure_text(F.col("t")), longest)
    got = spark.createDataFrame(rows, "t string, names array<string>").select(
        "t", "names", text.bound(near, lambda x: F.transform("names", lambda n: text.tenure_in(n, x, 2024))).alias("cut"),
        text.bound(text.tenure_text(F.col("t")), lambda x: F.transform("names", lambda n: text.tenure_in(n, x, 2024))).alias("whole"),
        F.transform("names", lambda n: text.tenure_years(n, F.col("t"), 2024)).alias("single")).collect()
    wrong = [(r.names, r.t, r.cut, r.whole, r.single) for r in got if not r.cut == r.whole == r.single]
    assert not wrong, wrong[:5]
    assert sum(y is not None for r in got for y in r.whole) > 2000


def test_names_are_not_sought_in_far_text(spark):
    far = "built things of many kinds. " * 5000
    value = f"{far}react {far}9 years of react {far}c++ (2019-2023){far}"
    row = spark.createDataFrame([(value,)], "t string").select(text.tenure_near(text.tenure_text(F.col("t")), F.lit(5))).first()
    assert len(row[0]) < 250 and "9 years of react" in row[0] and "c++ (2019-2023)" in row[0]
    short = spark.range(1).select(text.tenure_near(text.tenure_text(F.lit("3 years of go")), F.lit(2))).first()
    assert short[0] == "3 years of go"


def _sections(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, start_line int, type string, text string")


def test_matches_by_pair(spark):
    sections = _sections(spark, [
        (1, 0, "experience", "I used react daily in our shop. Then 4 years of react followed."), (1, 9, "skills", "react, sql"),
        (2, 0, "summary", "Nothing to see here at all."), (3, 0, "skills", None)])
    skills = spark.createDataFrame(
        [(7, "React", True), (7, "React", False), (8, "SQL", False), (8, None, True)], "role_id long, skill string, is_required boolean")
    pairs = spark.createDataFrame(
        [(1, 7, False), (1, 7, False), (1, 8, True), (2, 7, False), (3, 8, False), (4, 8, False)], "doc_id long, role_id long, fresher boolean")
    got = {(r.doc_id, r.role_id, r.skill): r for r in matching.match_skills(sections, skills, pairs, 2024).collect()}
    assert set(got) == {(1, 7, "React"), (1, 8, "SQL")}
    react = got[1, 7, "React"]
    assert react.is_required and react.best_section == "experience" and react.excerpt == "I used react daily in our shop"
    assert got[1, 8, "SQL"].best_section == "skills" and got[1, 8, "SQL"].work_score == 0.0
    empty = matching.match_skills(sections.limit(0), skills, pairs, 2024)
    assert empty.count() == 0


def test_no_text_leaves_its_row(spark):
    """Behind the search, neither the text nor its sentences are in an exchange."""
    sections = _sections(spark, [(1, 0, "skills", "react")])
    wanted = spark.createDataFrame([(1, [])], "doc_id long, skills array<struct<skill:string,name:string,words:array<string>,aliases:array<string>>>")
    assert set(matching.skill_hits(sections, wanted, 2024).columns) == {
        "doc_id", "skill", "start_line", "kind", "type", "excerpt", "plain", "fresh"}


def test_finds_of_a_document_are_not_shuffled_to_its_pairs(spark):
    import re

    from corpusfit.scale import cut_lineage

    sections = cut_lineage(spark.createDataFrame(
        [(k, 0, "projects", "built with react and kafka for 3 years") for k in range(20)], "doc_id long, start_line int, type string, text string"))
    pairs = cut_lineage(spark.createDataFrame(
        [(k, r, r == 2) for k in range(20) for r in (1, 2, 3)] + [(3, 1, True), (5, None, False)], "doc_id long, role_id int, fresher boolean"))
    skills = cut_lineage(spark.createDataFrame(
        [(1, "react", True), (2, "react", False), (2, "kafka", True), (3, "go", True), (1, None, True)], "role_id int, skill string, is_required boolean"))
    found = matching.match_skills(sections, skills, pairs, 2002)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, skill#", plan)
    # Only texts go through the exchange, not what is made of them.
    before, made = zip(*[(m.start(), plan[m.end():m.end() + 400]) for m in re.finditer(r"Exchange hashpartitioning\(doc_id#\d+L?, 4\)", plan)])
    assert not any("regexp" in x for x in made)
    got = {(r.doc_id, r.role_id, r.skill, r.is_required) for r in found.collect()}
    assert found.count() == len(got) and got == {
        (k, *x) for k in range(20) for x in ((1, "react", True), (2, "react", False), (2, "kafka", True))}
