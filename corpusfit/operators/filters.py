"""Row selection and per-row classification jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.operators.topk import sort_page

from corpusfit.functions import labels
from corpusfit.operators.windows import latest_status


def active_current(rows: DataFrame) -> DataFrame:
    """Current version, owner not deleted, scored or stopped by a filter."""
    return rows.filter(
        F.col("is_current")
        & ~F.coalesce(F.col("deleted"), F.lit(False))
        & (F.col("eval_status").isNull() | F.col("eval_status").isin(*labels.FILTERED))
    )


def gate_experience(pairs: DataFrame, roles: DataFrame) -> DataFrame:
    """Add ``gate_reason``: which entry rule of the role the owner fails, if any."""
    rules = roles.select(
        "role_id", "min_experience", "allowed_levels", "min_graduation_year", "max_graduation_year"
    )
    c = F.col
    return pairs.join(rules, "role_id").withColumn(
        "gate_reason",
        labels.gate_reason(
            c("years_experience"), c("level"), c("graduation_year"), c("min_experience"),
            c("allowed_levels"), c("min_graduation_year"), c("max_graduation_year"),
        ),
    )


def select_for_run(pairs: DataFrame, roles: DataFrame, evals: DataFrame) -> DataFrame:
    """Pairs to score: current, active, years and level acceptable or unknown, not scored yet.

    ``pairs`` holds role_id, doc_id and the owner's attributes.
    """
    allowed = F.filter(F.transform(F.split("allowed_levels", ","), lambda x: F.trim(x)), lambda x: x != "")
    current = pairs.filter(F.col("is_current") & ~F.coalesce(F.col("deleted"), F.lit(False)))
    due = current.join(roles.select("role_id", "min_experience", "allowed_levels"), "role_id").filter(
        (F.coalesce(F.col("min_experience"), F.lit(0)) <= 0)
        | F.col("years_experience").isNull()
        | (F.col("years_experience") >= F.col("min_experience"))
    ).filter(
        F.col("allowed_levels").isNull() | (F.size(allowed) == 0) | F.col("level").isNull()
        | F.array_contains(allowed, F.col("level"))
    )
    done = evals.filter(F.col("eval_status").isNull()).select("role_id", "doc_id")
    return due.select("role_id", "doc_id").distinct().join(done, ["role_id", "doc_id"], "left_anti")


def search_fields(
    df: DataFrame, q: str | None, cols: Sequence[str], eq: Mapping[str, object] | None = None,
    order: Sequence[Column] = (), page: int = 1, limit: int = 20,
) -> DataFrame:
    """Case-insensitive literal search over several columns plus equality filters, one page.

    The needle is matched literally, so % and _ need no escaping.
    """
    if q and q.strip():
        needle = q.strip().lower()
        hit = F.lit(False)
        for name in cols:
            hit = hit | F.coalesce(F.lower(name).contains(needle), F.lit(False))
        df = df.filter(hit)
    for name, value in (eq or {}).items():
        df = df.filter(F.col(name) == F.lit(value))
    if order:
        df = df.orderBy(*order)
    return df.offset((page - 1) * limit).limit(limit)


def snippet(text: Column, q: str) -> Column:
    """About 200 characters around the first hit of ``q`` with ellipses where text is cut."""
    at = F.locate(q.lower(), F.lower(text))
    size = F.length(text)
    start = F.greatest(F.lit(0), at - 1 - 80)
    end = F.least(size, at - 1 + len(q) + 120)
    found = F.concat(
        F.when(start > 0, "…").otherwise(""),
        F.regexp_replace(F.substring(text, start + 1, end - start), r"(?U)^\s+|\s+$", ""),
        F.when(end < size, "…").otherwise(""),
    )
    head = F.concat(F.substring(text, 1, 200), F.when(size > 200, "…").otherwise(""))
    return F.when(at > 0, found).otherwise(head)


def search_text(
    docs: DataFrame, evals: DataFrame, q: str, page: int = 1, limit: int = 20
) -> DataFrame:
    """Scored documents whose text holds ``q``, best score first, with a snippet.

    The page is cut from ids and scores; texts then meet the page's ids only. A deep page is sought, see ``topk.seek_page``.
    """
    hits = docs.filter(F.lower("text").contains(q.lower())).select("doc_id")
    scored = evals.filter(F.col("eval_status").isNull()) if "eval_status" in evals.columns else evals
    shown = sort_page(scored.join(hits, "doc_id"), "total_score", "desc", page, limit, "doc_id")
    return (
        F.broadcast(shown).join(docs.select("doc_id", "text"), "doc_id")
        .withColumn("snippet", snippet(F.col("text"), q)).drop("text").orderBy(F.desc("total_score"), "doc_id"))


def filter_by_status(evals: DataFrame, status_log: DataFrame, status: str) -> DataFrame:
    """Evaluations that count as ``status`` on the board (``evals`` has stage and review flag)."""
    if status == "pending":
        return evals.join(status_log.select("evaluation_id"), "evaluation_id", "left_anti")
    latest = latest_status(status_log).select("evaluation_id", "latest_status")
    rows = evals.join(latest, "evaluation_id", "left")
    logged = F.coalesce(F.col("latest_status") == status, F.lit(False))
    if status == "rejected":
        logged = logged | (F.col("stage") == "rejected") | F.coalesce(
            F.col("eval_status").isin(*labels.FILTERED), F.lit(False)
        )
    elif status == "review":
        logged = logged | F.coalesce(F.col("needs_review"), F.lit(False))
    return rows.filter(logged).select(*evals.columns)


def range_filters(
    df: DataFrame, score_min: float | None = None, score_max: float | None = None,
    grad_min: int | None = None, grad_max: int | None = None,
    status: str | None = None, level: str | None = None,
) -> DataFrame:
    """Score and graduation ranges (unknown years drop out), status groups, level (default entry)."""
    if score_min is not None:
        df = df.filter(F.col("total_score") >= score_min)
    if score_max is not None:
        df = df.filter(F.col("total_score") <= score_max)
    if grad_min is not None:
        df = df.filter(F.col("graduation_year") >= grad_min)
    if grad_max is not None:
        df = df.filter(F.col("graduation_year") <= grad_max)
    if status == "review":
        df = df.filter(
            (F.col("status") == "review")
            | (F.col("needs_review") & (F.col("status").isNull() | F.col("status").isin("done", "pending")))
            | ((F.col("status") == "pending") & (F.col("filter_stage") == "llm_scored"))
        )
    elif status == "rejected":
        df = df.filter((F.col("status") == "rejected") | F.col("filter_stage").isin(*labels.FILTERED))
    elif status:
        df = df.filter(F.col("status") == status)
    if level:
        df = df.filter(F.coalesce("level", F.lit("entry")) == level)
    return df


def review_buckets(rows: DataFrame) -> DataFrame:
    """One row per (bucket, evaluation); a row may be in several buckets.

    ``rows`` carries the role's graduation bounds next to the evaluation.
    """
    c = F.col
    no_github = F.coalesce(c("missed_requirement") == "GitHub", F.lit(False))
    borderline = (c("total_score") >= 55) & (c("total_score") < 65)
    grad = c("graduation_year")
    buckets = [
        ("missing_github", no_github),
        ("borderline_score", borderline & ~no_github),
        ("grad_year", (grad < c("min_graduation_year")) | (grad > c("max_graduation_year"))),
        ("experience_mismatch", c("filter_stage") == "experience_filtered"),
        ("low_tfidf", c("tfidf_score").between(0.08, 0.15)),
        ("manual_flag", (c("status") == "review") & ~no_github & ~borderline
         & (c("filter_stage") == "llm_scored")),
    ]
    named = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in buckets])
    return rows.select("evaluation_id", F.explode(F.array_compact(named)).alias("bucket"))


def review_bucket_total(buckets: DataFrame) -> DataFrame:
    """How many evaluations are in at least one bucket."""
    return buckets.agg(F.countDistinct("evaluation_id").alias("in_any_bucket"))


def skill_list_by_section(matches: DataFrame, section: str = "best_section") -> DataFrame:
    """Group matched skills by the kind of place they were found in."""
    place = (
        F.when(F.col(section).isin("projects", "experience", "work_experience"), "projects")
        .when(F.col(section).isin("skills_section", "skills", "certifications"), "skills")
        .when(F.col(section) == "education", "education").otherwise("other")
    )
    return matches.withColumn("found_in", place)


def subject_filter(df: DataFrame, subject: str, keywords: Sequence[str]) -> DataFrame:
    """Add ``route``: new when any keyword occurs (or none is set), else keyword_filtered."""
    if not keywords:
        return df.withColumn("route", F.lit("new"))
    words = F.array(*[F.lit(k.lower()) for k in keywords])
    hit = F.exists(words, lambda k: F.contains(F.lower(F.coalesce(subject, F.lit(""))), k))
    return df.withColumn("route", F.when(hit, "new").otherwise("keyword_filtered"))


def date_range_tz(
    df: DataFrame, ts: str, from_day: str, to_day: str, offset_min: int
) -> DataFrame:
    """Rows within local days, given the offset "UTC minus local" in minutes.

    The bounds are constants, so the filter reaches the scan.
    """
    shift = F.make_dt_interval(mins=F.lit(offset_min))
    low = F.to_timestamp_ntz(F.lit(from_day + " 00:00:00")) + shift
    high = F.to_timestamp_ntz(F.lit(to_day + " 23:59:59")) + shift
    return df.filter(F.col(ts).between(low, high))


def validate_roles(roles: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per (role, broken rule)."""
    c = F.col
    checks = {
        "weights must sum to 100":
            c("weight_projects") + c("weight_skills") + c("weight_education") != 100,
        "weight out of range": ~(
            c("weight_projects").between(0, 100) & c("weight_skills").between(0, 100)
            & c("weight_education").between(0, 100)),
        "min_experience below 0": c("min_experience") < 0,
        "min_fit_score out of range": ~c("min_fit_score").between(0, 100),
        "shortlist_target below 1": c("shortlist_target") < 1,
        "graduation bound out of range": ~(
            c("min_graduation_year").between(1980, 2040) & c("max_graduation_year").between(1980, 2040)),
        "unknown min_degree": ~c("min_degree").isin("", "bachelor", "master", "phd", "doctorate"),
    }
    named = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in checks.items()])
    found = roles.select("role_id", F.explode(F.array_compact(named)).alias("violation"))
    if rules is None:
        return found
    sums = (
        rules.groupBy("role_id").agg(F.sum("weight").alias("total"))
        .filter(F.abs(F.col("total") - 100.0) > 0.5)
        .select("role_id", F.lit("requirement weights must sum to 100").alias("violation"))
    )
    kinds = (
        rules.filter(~F.col("req_type").isin("skill", "experience", "education", "other"))
        .select("role_id", F.lit("unknown requirement type").alias("violation")).distinct()
    )
    return found.unionByName(sums).unionByName(kinds)


def clean_sections(sections: DataFrame, allowed: Sequence[str], col: str = "type") -> DataFrame:
    return sections.withColumn(
        col, F.when(F.col(col).isin(*allowed), F.col(col)).otherwise("unknown")
    )
