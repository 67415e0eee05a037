"""Export, upsert and audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.operators.windows import latest_status


def export_csv(
    rows: DataFrame, status_log: DataFrame, roles: DataFrame, role: int | None = None,
    status: str | None = None,
) -> DataFrame:
    """The 17 export columns of evaluations with owner columns, best score first.

    A status filter keeps evaluations that ever had it. ``write_csv`` stores the result.
    """
    for name in ("phone", "title", "level", "linkedin_url", "github_url", "portfolio_url"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    if role is not None:
        rows = rows.filter(F.col("role_id") == role)
    if status is not None:
        rows = rows.join(status_log.filter(F.col("status") == status).select("evaluation_id"), "evaluation_id", "left_semi")
    last = latest_status(status_log).select("evaluation_id", "latest_status")
    named = rows.join(last, "evaluation_id", "left").join(roles.select("role_id", F.col("title").alias("job_role")), "role_id", "left")

    def text(c):
        return F.coalesce(c, F.lit(""))

    def score(c):
        return F.bround(c, 1).alias(c)

    return named.orderBy(F.desc("total_score"), "evaluation_id").select(
        text("name").alias("candidate_name"), text("email").alias("email"), text("phone").alias("phone"),
        text("title").alias("current_title"), text("level").alias("experience_level"), "years_experience",
        text("stage").alias("stage"), score("total_score"), score("project_score"), score("skill_score"),
        score("education_score"), text("latest_status").alias("recommendation"),
        text("linkedin_url").alias("linkedin_url"), text("github_url").alias("github_url"),
        text("portfolio_url").alias("portfolio_url"), text("job_role").alias("job_role"),
        text(F.date_format("evaluated_at", "yyyy-MM-dd HH:mm")).alias("evaluated_at"))


def write_csv(df: DataFrame, path: str) -> None:
    """Part files in order, each with the header line."""
    df.write.mode("overwrite").option("header", True).csv(path)


def may_replace(old_status: Column, new_status: Column) -> Column:
    """Which run results may replace a stored one: a score always, an experience stop only
    stops and queue entries or finished rows, a relevance stop not an experience stop, and a
    queue entry nothing."""
    open_status = old_status.isNull()
    return (
        F.when(new_status.isNull(), True)
        .when(new_status == "experience_filtered",
              open_status | old_status.isin("experience_filtered", "tfidf_filtered", "queued"))
        .when(new_status == "tfidf_filtered", open_status | old_status.isin("tfidf_filtered", "queued"))
        .otherwise(False)
    )


def upsert_evaluations(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("role_id", "doc_id"),
    order: str = "evaluated_at",
) -> DataFrame:
    """One row per key: the incoming rows applied in order, each where the guard lets it replace what is there.

    The last score, if there is one, starts the result, else the stored row, else the first incoming row. Of the rows
    after it only the last experience stop, or else the last relevance stop, can still replace it.
    """
    values = [c for c in existing.columns if c not in keys]
    status, at, row = F.col("eval_status"), F.struct(F.col(order), F.xxhash64(*values)), F.struct(*values)

    def last(test: Column, name: str):
        return [F.max_by(row, F.when(test, at)).alias(f"__{name}"), F.max(F.when(test, at)).alias(f"__{name}_at")]

    runs = incoming.groupBy(*keys).agg(
        F.min_by(row, at).alias("__first"), F.min(at).alias("__first_at"), *last(status.isNull(), "score"),
        *last(status == "experience_filtered", "early"), *last(status == "tfidf_filtered", "weak"))
    old = existing.select(*keys, row.alias("__old"))
    both = old.join(runs, list(keys), "full")
    scored = F.col("__score_at").isNotNull()
    start = F.when(scored, F.col("__score")).when(F.col("__old").isNotNull(), F.col("__old")).otherwise(F.col("__first"))
    both = both.withColumn("__start", start)

    def after(name: str) -> Column:
        return F.col(f"__{name}_at").isNotNull() & (~scored | (F.col(f"__{name}_at") > F.col("__score_at"))) & may_replace(
            F.col("__start.eval_status"), F.col(f"__{name}.eval_status"))

    taken = F.when(after("early"), F.col("__early")).when(after("weak"), F.col("__weak")).otherwise(F.col("__start"))
    return both.withColumn("__row", taken).select(*keys, "__row.*")


def append_audit(
    old: DataFrame, new: DataFrame, key: str, cols: Sequence[str], action: str
) -> DataFrame:
    """One row per changed record with a map of changed fields to [old, new] texts."""
    a = old.select(key, *[F.col(c).cast("string").alias(f"__old_{c}") for c in cols])
    b = new.select(key, *[F.col(c).cast("string").alias(f"__new_{c}") for c in cols])
    entries = F.array(*[
        F.when(~F.col(f"__old_{c}").eqNullSafe(F.col(f"__new_{c}")),
               F.struct(F.lit(c).alias("k"), F.array(f"__old_{c}", f"__new_{c}").alias("v"))) for c in cols])
    return (
        a.join(b, key).withColumn("__changes", F.array_compact(entries)).filter(F.size("__changes") > 0)
        .select(F.col(key).alias("target_id"), F.lit(action).alias("action"),
                F.map_from_entries("__changes").alias("changes")))
