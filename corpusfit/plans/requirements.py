"""Scores from typed role rules, each with its own weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.functions.text import (
    all_matches, edu_score, norm_tech, skill_aliases, strip, tenure_years,
)
from corpusfit.operators.topk import best_excerpt
from corpusfit.plans.scoring import majors_of, shown
from corpusfit.plans import vectors
from corpusfit.plans.tfidf import TECH_WORD
from corpusfit.scale import by_shuffle, cut_lineage


TOP_SECTION_WEIGHT = 1.2


def _idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def rule_similarity(sections: DataFrame, rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of each (doc, role, rule, section) over the corpus "sections of doc + rules of role".

    The idf of a term depends on the pair, but for terms the two sides do not share it
    depends only on their own counts. So each side keeps its squared weights summed by
    document frequency, and only shared terms become rows of a pair. Sections of one
    document and rules of one role are short lists.
    """
    query = F.concat_ws(" ", F.array(F.col("label")), skill_aliases(F.col("label")))
    rule_vectors = cut_lineage(vectors.group_vectors(rules, "role_id", "rule_id", norm_tech(query), 3, TECH_WORD))
    known = vectors.vocabulary(rule_vectors)
    doc_vectors = cut_lineage(vectors.group_vectors(sections, "doc_id", "start_line", norm_tech(F.col("text")), 3, TECH_WORD, known))

    def parts(rows, group, df, out):
        named = rows.select(group, F.explode("terms").alias("t")).select(
            group, F.col("t.term").alias("term"), F.col("t.df").alias(df), F.col("t.rows").alias(f"{df}_rows"))
        return named, rows.select(group, F.inline("own")).withColumnRenamed("own", out)

    doc_terms, doc_own = parts(doc_vectors, "doc_id", "ds", "sec_own")
    role_terms, role_own = parts(rule_vectors, "role_id", "dr", "rule_own")
    n_sec = doc_vectors.select("doc_id", F.col("n_items").alias("n_sec"))
    n_req = rule_vectors.select("role_id", F.col("n_items").alias("n_req"))
    sized = pairs.select("doc_id", "role_id").distinct().join(by_shuffle(n_sec), "doc_id").join(n_req, "role_id").withColumn(
        "n", F.col("n_sec") + F.col("n_req"))
    met = sized.join(by_shuffle(doc_terms), "doc_id").join(role_terms, ["role_id", "term"])
    shared = met.withColumn("idf", _idf(F.col("n"), F.col("ds") + F.col("dr"))).select(
        "doc_id", "role_id", "idf",
        (F.pow("idf", 2) - F.pow(_idf(F.col("n"), F.col("ds")), 2)).alias("fix_s"),
        (F.pow("idf", 2) - F.pow(_idf(F.col("n"), F.col("dr")), 2)).alias("fix_r"), "ds_rows", "dr_rows")
    key = ["doc_id", "role_id"]
    one = shared.select(*key, "idf", "fix_s", "fix_r", F.explode("ds_rows").alias("a"), "dr_rows")
    dots = one.select(*key, "idf", "a", F.explode("dr_rows").alias("b")).groupBy(
        *key, F.col("a.start_line").alias("start_line"), F.col("b.rule_id").alias("rule_id")
    ).agg(F.sum(F.col("a.w") * F.col("b.w") * F.col("idf") * F.col("idf")).alias("dot"))
    sec_fix = one.groupBy(*key, F.col("a.start_line").alias("start_line")).agg(
        F.sum(F.col("a.w") * F.col("a.w") * F.col("fix_s")).alias("sec_fix"))
    rule_fix = shared.select(*key, "fix_r", F.explode("dr_rows").alias("b")).groupBy(
        *key, F.col("b.rule_id").alias("rule_id")).agg(F.sum(F.col("b.w") * F.col("b.w") * F.col("fix_r")).alias("rule_fix"))

    def own(rows):
        return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["s"] * F.pow(_idf(F.col("n"), x["df"]), 2))

    full = (
        dots.join(sec_fix, [*key, "start_line"]).join(rule_fix, [*key, "rule_id"])
        .join(by_shuffle(sized.select(*key, "n")), key).join(by_shuffle(doc_own), ["doc_id", "start_line"]))
    full = full.join(role_own, ["role_id", "rule_id"])
    norm = F.sqrt(own("sec_own") + F.col("sec_fix")) * F.sqrt(own("rule_own") + F.col("rule_fix"))
    return full.select(*key, "rule_id", "start_line", F.least(F.col("dot") / F.nullif(norm, F.lit(0.0)), F.lit(1.0)).alias("cosine"))


def _label_words(label: Column) -> Column:
    return F.filter(F.split(F.lower(label), r"\s+"), lambda w: F.length(w) > 3)


def _share(words: Column, text: Column) -> Column:
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))
    return F.least(hits / F.greatest(F.size(words), F.lit(1)), F.lit(1.0))


def requirement_breakdown(
    sections: DataFrame, rules: DataFrame, roles: DataFrame, pairs: DataFrame, as_of_year: int
) -> DataFrame:
    """One row per (doc, role, rule): raw score 0..1 and the text that supports it."""
    c = F.col
    sections = sections.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    text_rules = rules.filter(c("req_type").isin("skill", "other"))
    sims = rule_similarity(sections, rules, pairs)
    ranked = sims.join(by_shuffle(sections.select("doc_id", "start_line", "weight", "text")), ["doc_id", "start_line"]).withColumn(
        "effective", c("cosine") * c("weight"))
    ranked = ranked.join(text_rules.select("role_id", "rule_id", "label"), ["role_id", "rule_id"]).filter("effective > 0")
    best = ranked.withColumn("evidence", best_excerpt(c("text"), c("label"))).groupBy("doc_id", "role_id", "rule_id").agg(
        F.max("effective").alias("best"), F.max_by("evidence", F.struct("effective", -c("start_line"))).alias("evidence"))
    wanted = pairs.select("doc_id", "role_id").distinct().join(
        text_rules.select("role_id", "rule_id", "label", "req_type", "weight"), "role_id")
    skill_rows = wanted.join(best, ["doc_id", "role_id", "rule_id"], "left").select(
        "doc_id", "role_id", "rule_id", "label", "req_type", "weight",
        F.least(F.coalesce("best", F.lit(0.0)) / TOP_SECTION_WEIGHT, F.lit(1.0)).alias("raw"), "evidence")

    parts = F.array_sort(F.collect_list(F.struct("start_line", "type", "text")))

    def joined(keep):
        return strip(F.array_join(F.transform(F.filter("__p", keep), lambda p: p["text"]), " "))

    texts = sections.groupBy("doc_id").agg(parts.alias("__p")).select(
        "doc_id", joined(lambda p: p["type"] == "education").alias("edu_text"),
        F.when(F.exists("__p", lambda p: p["type"] == "experience"), joined(lambda p: p["type"] == "experience"))
        .otherwise(F.array_join(F.transform("__p", lambda p: p["text"]), " ")).alias("exp_text"))
    other = rules.filter(c("req_type").isin("education", "experience"))
    settings = roles.select("role_id", "min_degree", "preferred_majors")
    rows = pairs.select("doc_id", "role_id").distinct().join(by_shuffle(texts), "doc_id").join(settings, "role_id").join(other, "role_id")
    words = _label_words(c("label"))
    edu_base = edu_score(c("edu_text"), c("min_degree"), majors_of(c("preferred_majors")))
    edu_raw = F.least(edu_base + _share(words, c("edu_text")) * 0.5 * (1.0 - edu_base), F.lit(1.0))
    kw = _share(words, c("exp_text"))
    stated = tenure_years(c("label"), c("exp_text"), as_of_year)
    asked = F.nullif(F.regexp_extract("label", r"(?i)(\d+)\+?\s*years?", 1), F.lit("")).try_cast("int")
    years_seen = F.size(all_matches(c("exp_text"), r"\b(20\d\d|19\d\d)\b"))
    exp_raw = F.when(
        c("min_years") > 0,
        F.when(stated.isNotNull(), F.least(stated / c("min_years"), F.lit(1.0))).otherwise(kw * 0.65),
    ).otherwise(F.when(years_seen >= asked, F.greatest(kw, F.lit(0.7))).otherwise(kw))
    raw = F.when(c("req_type") == "education", edu_raw).otherwise(exp_raw)
    text_rows = rows.withColumn("raw", raw).select(
        "doc_id", "role_id", "rule_id", "label", "req_type", "weight", "raw",
        F.when(c("raw") > 0.1, F.when(c("req_type") == "education", F.nullif(F.col("edu_text"), F.lit("")))
               .otherwise(best_excerpt(c("exp_text"), c("label")))).alias("evidence"))
    return skill_rows.unionByName(text_rows)


def score_requirements(
    breakdown: DataFrame, roles: DataFrame, jd: DataFrame | None = None
) -> DataFrame:
    """Totals and per-type averages from the rule rows; the rules stay as an array column."""
    c = F.col
    rows = breakdown.join(roles.select("role_id", "cosine_threshold"), "role_id")

    def average(kind):
        w = F.sum(F.when(kind, c("weight")))
        return F.coalesce(F.sum(F.when(kind, c("raw") * c("weight"))) / F.nullif(w, F.lit(0.0)), F.lit(0.0))

    is_text = c("req_type").isin("skill", "other")
    sums = rows.groupBy("doc_id", "role_id").agg(
        F.sum(c("raw") * c("weight") / 100.0).alias("weighted"),
        average(is_text & (c("raw") >= c("cosine_threshold"))).alias("skill_raw"),
        average(c("req_type") == "experience").alias("project_raw"),
        average(c("req_type") == "education").alias("edu_raw"),
        F.max_by("evidence", F.when(c("evidence").isNotNull(), F.struct("raw", -c("rule_id")))).alias("top_excerpt"),
        F.array_sort(F.collect_list(F.struct(
            "rule_id", "label", "req_type", "weight", F.bround(c("raw") * 100, 2).alias("score"), "evidence"))).alias("breakdown"))
    sums = sums.join(by_shuffle(jd.select("doc_id", "role_id", c("score").alias("jd"))), ["doc_id", "role_id"], "left").na.fill(0.0, ["jd"]) if (
        jd is not None) else sums.withColumn("jd", F.lit(0.0))
    total = F.when(c("jd") > 0, c("weighted") * 100 * 0.85 + c("jd") * 100 * 0.15).otherwise(c("weighted") * 100)
    project = F.when(c("jd") > 0, c("project_raw") * 0.70 + c("jd") * 0.30).otherwise(c("project_raw"))
    return sums.select(
        "doc_id", "role_id",
        shown(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 0).cast("int").alias("total"),
        shown(project * 100).alias("project_score"), shown(c("skill_raw") * 100).alias("skill_score"),
        shown(c("edu_raw") * 100).alias("education_score"), F.lit(0.0).alias("experience_score"),
        shown(c("jd") * 100).alias("jd_alignment"), "top_excerpt", "breakdown")
