"""Counts, averages, funnels and curves. Each is one grouped pass with map-side merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.functions import labels
from corpusfit.operators.windows import latest_status

# Hiring stages in board order with their labels.
STAGES = ("applied", "screening", "coding", "interview", "offer", "hired", "rejected")
STAGE_LABELS = ("Applied", "Screening", "Coding Test", "Interview", "Offer", "Hired", "Rejected")
# Outcomes that count against a candidate.
NEGATIVE_OUTCOMES = ("rejected", "withdrew", "ghosted", "declined")


def score_bin(score: Column, bins: int = 10) -> Column:
    width = 100 / bins
    return F.least(F.floor(score / width), F.lit(bins - 1))


def _all_bins(df: DataFrame, bins: int) -> DataFrame:
    width = 100 // bins
    return df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        F.concat((F.col("id") * width).cast("string"), F.lit("-"),
                 ((F.col("id") + 1) * width).cast("string")).alias("range"),
    )


def score_histogram(evals: DataFrame, bins: int = 10) -> DataFrame:
    counted = evals.groupBy(score_bin(F.col("total_score"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    return _all_bins(evals, bins).join(counted, "bin", "left").select(
        "range", F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def overall_averages(evals: DataFrame) -> DataFrame:
    def mean(c):
        return F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 1)

    return evals.agg(
        F.count(F.lit(1)).alias("total_evaluated"),
        mean("total_score").alias("avg_score"),
        mean("project_score").alias("avg_projects"),
        mean("skill_score").alias("avg_skills"),
        mean("education_score").alias("avg_education"),
        F.count_if("needs_review").alias("needs_review_count"),
    )


def status_counts(evals: DataFrame, status_log: DataFrame) -> DataFrame:
    """Evaluations per last logged status; none when nothing was logged."""
    return (
        evals.select("evaluation_id").join(latest_status(status_log), "evaluation_id", "left")
        .groupBy(F.coalesce("latest_status", F.lit("none")).alias("status"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def skill_match_rates(
    evals: DataFrame, matches: DataFrame, role_skills: DataFrame | None = None, top: int = 20
) -> DataFrame:
    """Share of evaluations that matched each skill.

    With ``role_skills``: every skill of each role against the evaluations of that
    role. Without: the ``top`` most matched skills over all evaluations.
    """
    hits = matches.select("evaluation_id", "skill").join(
        evals.select("evaluation_id", "role_id"), "evaluation_id")
    if role_skills is None:
        total = evals.agg(F.count(F.lit(1)).alias("total")).scalar()
        counted = hits.groupBy("skill").agg(F.count(F.lit(1)).alias("matched_count"))
        best = counted.orderBy(F.desc("matched_count"), "skill").limit(top)
        out = best.withColumn("total", total)
    else:
        totals = evals.groupBy("role_id").agg(F.count(F.lit(1)).alias("total"))
        counted = hits.groupBy("role_id", "skill").agg(F.count(F.lit(1)).alias("matched_count"))
        out = (
            role_skills.select("role_id", "skill")
            .join(counted, ["role_id", "skill"], "left").join(totals, "role_id", "left")
            .na.fill(0, ["matched_count", "total"])
        )
    rate = F.when(F.col("total") > 0, F.bround(F.col("matched_count") / F.col("total") * 100, 1)).otherwise(0.0)
    return out.withColumn("match_rate", rate)


def top_skill_gaps(rates: DataFrame, below: float = 50, n: int = 10) -> DataFrame:
    keys = ["match_rate", "skill"] + (["role_id"] if "role_id" in rates.columns else [])
    return rates.filter(F.col("match_rate") < below).orderBy(*keys).limit(n)


def daily_counts(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    """Rows per day for the last ``days`` days up to ``as_of``, zero-filled."""
    last = F.to_date(F.lit(as_of))
    first = F.date_sub(last, days - 1)
    counted = (
        df.filter((F.col(ts) >= first.cast("timestamp_ntz"))
                  & (F.col(ts) < F.date_add(last, 1).cast("timestamp_ntz")))
        .groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    )
    calendar = df.sparkSession.range(days).select(
        F.date_add(first, F.col("id").cast("int")).alias("day"))
    return calendar.join(counted, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def stage_funnel(rows: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Evaluations per stage of their owner in board order, zero-filled."""
    names = dict(zip(STAGES, STAGE_LABELS))
    board = rows.sparkSession.createDataFrame(
        [(i + 1, s, names.get(s, s)) for i, s in enumerate(stages)], "position int, stage string, label string")
    counted = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return board.join(counted, "stage", "left").select(
        "position", "stage", "label", F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def level_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.col("level"), F.lit("")), F.lit("unknown")).alias("level")).agg(
        F.count(F.lit(1)).alias("count"), F.bround(F.avg("total_score"), 1).alias("avg_score"))


def calibration_buckets(joined: DataFrame, bins: int = 10) -> DataFrame:
    counted = joined.groupBy(score_bin(F.col("total_score"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("outcome") == "hired").alias("hired"),
        F.count_if(F.col("outcome").isin(*NEGATIVE_OUTCOMES)).alias("rejected"),
    )
    out = _all_bins(joined, bins).join(counted, "bin", "left").na.fill(0, ["total", "hired", "rejected"])
    return out.withColumn(
        "hire_rate",
        F.when(F.col("total") > 0, F.bround(F.col("hired") / F.col("total") * 100, 1)).otherwise(0.0))


def threshold_curve(buckets: DataFrame) -> DataFrame:
    """Precision, recall and F1 when only scores from each threshold up are taken.

    Works on the fixed set of bins, so the suffix sums run over ten rows.
    """
    def above(c):
        return F.expr(f"sum({c}) over (order by bin desc rows unbounded preceding)")

    sums = buckets.select(
        "bin", above("total").alias("candidates_above"), above("hired").alias("__hired"),
        F.expr("sum(hired) over ()").alias("__all_hired"))
    precision = F.col("__hired") / F.col("candidates_above")
    recall = F.when(F.col("__all_hired") > 0, F.col("__hired") / F.col("__all_hired")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.filter("bin >= 1 and candidates_above > 0").select(
        (F.col("bin") * 10).cast("double").alias("threshold"),
        F.bround(precision * 100, 1).alias("precision"), F.bround(recall * 100, 1).alias("recall"),
        F.bround(f1 * 100, 1).alias("f1"), "candidates_above")


def suggest_threshold(curve: DataFrame, min_above: int = 2) -> DataFrame:
    """Threshold with the best rounded F1; the lowest one on ties."""
    return curve.filter(F.col("candidates_above") >= min_above).agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("suggested_threshold"))


def summary_counts(rows: DataFrame, status_log: DataFrame) -> DataFrame:
    """All board totals in one pass. ``rows`` = evaluations with version and owner columns."""
    last = latest_status(status_log).select("evaluation_id", "latest_status")
    alive = ~F.coalesce(F.col("deleted"), F.lit(False))
    filtered = F.coalesce(F.col("eval_status").isin(*labels.FILTERED), F.lit(False))
    on_board = alive & F.col("is_current") & (F.col("eval_status").isNull() | filtered)
    review = F.coalesce(F.col("needs_review"), F.lit(False))

    def n(test, name):
        return F.count_if(test).alias(name)

    return rows.join(last, "evaluation_id", "left").agg(
        n(on_board, "total"),
        F.bround(F.coalesce(F.avg(F.when(on_board, F.col("total_score"))), F.lit(0.0)), 1).alias("avg_score"),
        n(on_board & (F.col("latest_status") == "shortlisted"), "shortlisted"),
        n(on_board & review, "needs_review"),
        n(on_board & F.col("latest_status").isNull() & ~review & ~filtered, "pending"),
        n(on_board & (F.col("eval_status") == "tfidf_filtered"), "tfidf_filtered"),
        n(on_board & (F.col("eval_status") == "experience_filtered"), "experience_filtered"),
        n(alive & (F.col("eval_status") == "queued"), "queued"),
    )


def run_progress(evals: DataFrame) -> DataFrame:
    """Counts by state for each role and whether work is left."""
    s = F.col("eval_status")
    return evals.groupBy("role_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s.isNull()).alias("scored"),
        F.count_if(s == "queued").alias("queued"), F.count_if(s == "processing").alias("processing"),
        F.count_if(s.endswith("_filtered")).alias("filtered"), F.count_if(s == "error").alias("error"),
    ).withColumn("in_progress", F.col("queued") + F.col("processing") > 0)


def intake_stats(landing: DataFrame) -> DataFrame:
    s = F.col("status")
    return landing.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "processed").alias("processed"),
        F.count_if(s == "failed").alias("failed"), F.count_if(s == "new").alias("new"),
        F.count_if(s == "no_attachment").alias("no_attachment"),
        F.count_if(s == "keyword_filtered").alias("keyword_filtered"))


def feedback_averages(feedback: DataFrame, owner: str = "owner") -> DataFrame:
    return feedback.groupBy(owner).agg(
        F.count(F.lit(1)).alias("responses"),
        *[F.bround(F.avg(c), 1).alias(f"avg_{c}") for c in ("rating", "technical", "communication", "culture_fit")])


def weighted_average(score: Column, weight: Column) -> Column:
    """Aggregate expression Σ(s·w)/Σw, 0 when there is no weight."""
    return F.coalesce(F.sum(score * weight) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0))


def activity_score(repos: DataFrame, as_of: str, owner: str = "owner") -> DataFrame:
    """0..100 from repository count (30), share updated in 12 months (40) and stars (30)."""
    months = F.datediff(F.to_date(F.lit(as_of)), F.to_date("updated_at")) / 30.44
    n = F.count(F.lit(1))
    score = (
        F.least(n, F.lit(30)) / 30.0 * 30 + F.count_if(months < 12) / n * 40
        + F.least(F.sum("stars"), F.lit(50)) / 50.0 * 30
    )
    return repos.groupBy(owner).agg(n.alias("repos"), F.bround(score, 0).cast("int").alias("activity_score"))


def language_ranking(repos: DataFrame, owner: str = "owner") -> DataFrame:
    return (
        repos.filter(F.coalesce("language", F.lit("")) != "").groupBy(owner, "language")
        .agg(F.count(F.lit(1)).alias("repo_count"))
    )


def inferred_skills(repos: DataFrame, known: DataFrame, owner: str = "owner") -> DataFrame:
    """Languages of an owner that are not known skills yet, with the names of their repositories as evidence."""
    named = repos.filter(F.coalesce("language", F.lit("")) != "").withColumn("__k", F.lower("language"))
    have = known.select(F.col(owner), F.lower("skill").alias("__k")).distinct()
    fresh = named.join(have, [owner, "__k"], "left_anti")
    return fresh.groupBy(owner, "language").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("repo_id", "name"))), lambda x: x["name"]), ", ")
        .alias("evidence"))
