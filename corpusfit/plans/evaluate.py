"""The staged evaluation of (document, role) pairs and what follows from its results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfit.functions import labels
from corpusfit.functions.text import fit_summary
from corpusfit.operators.filters import gate_experience
from corpusfit.plans import matching, requirements, scoring, tfidf
from corpusfit.scale import by_shuffle, cut_lineage

MAIL_FROM = 85


def evaluate(
    docs: DataFrame, sections: DataFrame, pairs: DataFrame, roles: DataFrame, role_skills: DataFrame,
    rules: DataFrame, modifiers: DataFrame, as_of_year: int,
) -> DataFrame:
    """Evaluation rows for all pairs: queued, stopped by a filter, or scored.

    ``pairs`` has doc_id, role_id and the owner's years_experience, level and
    graduation_year. Cheap stages run first and the scorer sees only what they pass; the
    routed pairs are written to the checkpoint folder once, since three branches read them.
    Roles whose weights do not sum to 100 give no score row.
    """
    c = F.col
    names = role_skills.groupBy("role_id").agg(F.array_sort(F.collect_set("skill")).alias("__skills"))
    role_docs = roles.join(names, "role_id", "left").withColumn(
        "__skills", F.coalesce("__skills", F.array().cast("array<string>"))).withColumn(
        "role_doc", tfidf.role_document(c("__skills"), c("description")))
    routed = (
        gate_experience(pairs, roles)
        .join(role_docs.select("role_id", "intake_paused", "tfidf_threshold", "is_entry_level", "__skills"), "role_id"))
    open_pairs = routed.filter(~c("intake_paused") & c("gate_reason").isNull())
    relevance = tfidf.tfidf_relevance(docs, role_docs, open_pairs.select("doc_id", "role_id"))
    routed = cut_lineage(routed.join(
        by_shuffle(relevance.select("doc_id", "role_id", c("score").alias("tfidf_score"))), ["doc_id", "role_id"], "left"
    ).withColumn("eval_status", F.when(c("intake_paused"), "queued").when(c("gate_reason").isNotNull(), "experience_filtered")
                 .when((c("tfidf_threshold") > 0) & (c("tfidf_score") < c("tfidf_threshold")), "tfidf_filtered"))
     .withColumn("fresher", labels.is_fresher(c("is_entry_level"), c("level"), c("graduation_year"), as_of_year)))

    ready = routed.filter(c("eval_status").isNull()).select("doc_id", "role_id", "fresher", "years_experience")
    by_rules = ready.join(rules.select("role_id").distinct(), "role_id", "left_semi")
    by_skills = ready.join(rules.select("role_id").distinct(), "role_id", "left_anti")
    jd = tfidf.jd_alignment(sections, roles, ready)
    found = matching.match_skills(sections, role_skills, by_skills, as_of_year)
    scored = scoring.score_documents(found, sections, roles, role_skills, by_skills, jd)
    ruled = requirements.score_requirements(
        requirements.requirement_breakdown(sections, rules, roles, by_rules, as_of_year), roles, jd).select(*scored.columns)
    both = scored.unionByName(ruled).join(by_shuffle(modifiers.select("doc_id", "role_id", "modifier")), ["doc_id", "role_id"], "left")
    final = both.select(
        "doc_id", "role_id", F.lit(None).cast("string").alias("eval_status"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("total") + F.coalesce("modifier", F.lit(0.0)))).alias("total_score"),
        "project_score", "skill_score", "education_score", "experience_score", "jd_alignment",
    ).join(by_shuffle(routed.select("doc_id", "role_id", "tfidf_score")), ["doc_id", "role_id"])

    stopped = routed.filter(c("eval_status").isNotNull())
    hits = stopped.filter("eval_status = 'tfidf_filtered'").join(by_shuffle(docs.select("doc_id", "text")), "doc_id").select(
        "doc_id", "role_id", F.array_join(tfidf.keyword_hits(c("text"), c("__skills")), ", ").alias("__hits"))
    early = F.concat(F.lit("Entry rules: "), c("gate_reason"), F.lit(". Not scored."))
    weak = F.concat(
        F.lit("Relevance "), F.bround(c("tfidf_score") * 100, 0).cast("int").cast("string"),
        F.lit("% is below the threshold of the role. Not scored. Skills named: "),
        F.coalesce(F.nullif(c("__hits"), F.lit("")), F.lit("none")), F.lit("."))
    zero = [F.lit(0.0).alias(n) for n in ("project_score", "skill_score", "education_score", "experience_score", "jd_alignment")]
    early_rows = stopped.join(by_shuffle(hits), ["doc_id", "role_id"], "left").select(
        "doc_id", "role_id", "eval_status",
        F.when(c("eval_status") == "tfidf_filtered", F.bround(c("tfidf_score") * 20, 1)).otherwise(0.0).alias("total_score"), *zero,
        F.when(c("eval_status") == "tfidf_filtered", c("tfidf_score")).alias("tfidf_score"),
        F.when(c("eval_status") == "tfidf_filtered", weak).when(c("eval_status") == "experience_filtered", early).alias("summary"))
    return final.withColumn("summary", F.lit(None).cast("string")).unionByName(early_rows)


def summaries(evals: DataFrame, people: DataFrame, roles: DataFrame, matches: DataFrame, gaps: DataFrame) -> DataFrame:
    """Sentences for scored pairs; matched and missing skills are short lists per pair."""
    key = ["doc_id", "role_id"]
    none = F.array().cast("array<string>")

    def listed(rows, name):
        return rows.groupBy(*key).agg(F.array_sort(F.collect_set("skill")).alias(name))

    rows = evals.filter("eval_status is null").join(roles.select("role_id", "title"), "role_id").join(
        people.select("doc_id", "name"), "doc_id", "left").join(listed(matches, "__m"), key, "left").join(
        listed(gaps, "__g"), key, "left")
    return rows.select(*key, fit_summary(
        F.col("name"), F.col("title"), F.col("total_score"), F.col("education_score"), F.coalesce("__m", none),
        F.coalesce("__g", none), F.col("jd_alignment")).alias("summary"))


def auto_shortlist(evals: DataFrame, roles: DataFrame, log: DataFrame) -> DataFrame:
    """New log rows: scored pairs at or above the role's minimum that have no log row yet."""
    scored = evals.filter("eval_status is null").join(roles.select("role_id", "min_fit_score"), "role_id")
    good = scored.filter("total_score >= min_fit_score")
    return good.join(log.select("evaluation_id"), "evaluation_id", "left_anti").select(
        "evaluation_id", F.lit("shortlisted").alias("status"))


def auto_pause(evals: DataFrame, roles: DataFrame) -> DataFrame:
    """Roles whose qualified count has reached the target."""
    good = evals.select("role_id", "total_score").join(roles.select("role_id", "min_fit_score"), "role_id").filter(
        "total_score >= min_fit_score").groupBy("role_id").agg(F.count(F.lit(1)).alias("qualified"))
    return roles.join(good, "role_id", "left").na.fill(0, ["qualified"]).select(
        "role_id", "qualified", "shortlist_target",
        (F.coalesce("intake_paused", F.lit(False)) | F.coalesce(F.col("qualified") >= F.col("shortlist_target"), F.lit(False))).alias("paused"))


def outreach_list(
    evals: DataFrame, log: DataFrame, candidates: DataFrame, roles: DataFrame, min_total: float = MAIL_FROM
) -> DataFrame:
    """Who gets a message: high scores of roles that allow it, and anyone ever shortlisted, unless sent."""
    reachable = candidates.filter(F.coalesce("email", F.lit("")) != "").select("candidate_id", "email")
    unsent = evals.filter("email_sent_at is null").join(reachable, "candidate_id")
    high = (
        unsent.filter((F.col("total_score") >= min_total) & F.col("eval_status").isNull())
        .join(roles.filter("auto_email").select("role_id"), "role_id"))
    picked = unsent.join(log.filter("status = 'shortlisted'").select("evaluation_id"), "evaluation_id", "left_semi")
    tagged = high.select("evaluation_id", "email", F.lit("score").alias("why")).unionByName(
        picked.select("evaluation_id", "email", F.lit("shortlist").alias("why")))
    return tagged.groupBy("evaluation_id", "email").agg(F.min("why").alias("why"))
