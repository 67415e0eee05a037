from pyspark.sql import functions as F

from corpusfit.plans.segment import centroid_classify, is_header_candidate, nearest_header, segment


def sections(spark, text, **kw):
    rows = segment(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).collect()
    return [(r.type, r.title, r.start_line, r.end_line, r.text, r.confidence) for r in sorted(rows, key=lambda r: r.start_line)]


def test_header_candidates(spark):
    lines = {"EXPERIENCE": True, "Work Experience": True, "skills:": True, "- Python": False, "• Skills": False,
             "I worked here.": False, "x": False, "2019 - 2020": False, "lower case line": False, "A" * 61: False}
    rows = spark.createDataFrame([(k,) for k in lines], "s string").select("s", is_header_candidate(F.col("s")).alias("ok")).collect()
    assert {r.s: r.ok for r in rows} == lines


def test_exact_fuzzy_and_bullets(spark):
    got = sections(spark, "Intro line here.\nExperience\nBuilt things\n- Skills\nSkils\nSpark, Scala\n\nEDUCATON:\nBSc")
    assert got == [
        ("experience", "Experience", 1, 3, "Built things\n- Skills", 1.0),
        ("skills", "Skils", 4, 6, "Spark, Scala", 0.85),
        ("education", "EDUCATON:", 7, 8, "BSc", 0.85)]


def test_no_header_is_one_section(spark):
    assert sections(spark, "just text\nmore text") == [("other", "", 0, 1, "just text\nmore text", 0.5)]
    assert sections(spark, None)[0][0] == "other"


def test_vector_types_fill_unknown_headings(spark):
    known = spark.createDataFrame([("My Toolbelt", "skills")], "line string, type string")
    got = sections(spark, "My Toolbelt\nSpark\nSummary\nok", vector_types=known)
    assert [(g[0], g[5]) for g in got] == [("skills", 0.70), ("summary", 1.0)]


def test_nearest_header_prefers_distance_then_order(spark):
    row = spark.createDataFrame([("skill",), ("profil",), ("zzzz",)], "w string").select("w", nearest_header(F.col("w")).alias("h")).collect()
    got = {r.w: (r.h.type, r.h.distance) if r.h else None for r in row}
    assert got == {"skill": ("skills", 1), "profil": ("summary", 1), "zzzz": None}


def test_centroid_threshold_is_strict(spark):
    train = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    asked = spark.createDataFrame([(9, [1.0, 1.0]), (8, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.label for r in centroid_classify(asked, train, 0.75).collect()}
    assert got == {8: 0}
