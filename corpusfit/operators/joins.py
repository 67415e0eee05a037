"""Lookups, anti/semi selections, identity resolution and source reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfit.functions.dates import month_gap
from corpusfit.scale import ordered_rank, salted_join


def anti_deleted(facts: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Facts whose key is not in ``deleted``; a null key is kept (no null-aware NOT IN)."""
    return facts.join(deleted.select(key).distinct(), key, "left_anti")


def semi_match(facts: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return facts.join(ids.select(key), key, "left_semi")


def lookup_titles(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Add the columns of a small keyed table."""
    return df.join(dim, key, "left")


def skill_gaps(evals: DataFrame, role_skills: DataFrame, matches: DataFrame) -> DataFrame:
    """Skills of the evaluation's role that were not matched (case-insensitive)."""
    wanted = evals.select("evaluation_id", "role_id").join(role_skills.select("role_id", "skill"), "role_id")
    have = matches.select("evaluation_id", F.lower("skill").alias("__key")).distinct()
    return (
        wanted.withColumn("__key", F.lower("skill"))
        .join(have, ["evaluation_id", "__key"], "left_anti").drop("__key")
    )


def resolve_entities(incoming: DataFrame, candidates: DataFrame) -> DataFrame:
    """Which known person each document belongs to, and by which rule.

    Order: sender address, address inside the document, then name among people who
    are not deleted. The lookup sides hold one id per key (the smallest), and empty
    or popular keys on the incoming side are spread over tasks.
    """
    def ids_by(expr, rows):
        return (
            rows.select(expr.alias("__key"), "candidate_id").filter("__key is not null and __key <> ''")
            .groupBy("__key").agg(F.min("candidate_id").alias("__id"))
        )

    by_email = ids_by(F.lower("email"), candidates)
    by_name = ids_by(
        F.lower(F.trim("name")), candidates.filter(~F.coalesce(F.col("deleted"), F.lit(False)))
    )
    out = incoming.withColumn("__sender", F.lower("sender_email")).withColumn(
        "__inside", F.lower("doc_email")).withColumn("__name", F.lower(F.trim("name")))
    for source, table, hit in (
        ("__sender", by_email, "__by_sender"), ("__inside", by_email, "__by_inside"),
        ("__name", by_name, "__by_name"),
    ):
        out = salted_join(
            out, table.select(F.col("__key").alias(source), F.col("__id").alias(hit)), source, "left"
        )
    return out.select(
        "incoming_id",
        F.coalesce("__by_sender", "__by_inside", "__by_name").alias("candidate_id"),
        F.when(F.col("__by_sender").isNotNull(), "sender_email")
        .when(F.col("__by_inside").isNotNull(), "document_email")
        .when(F.col("__by_name").isNotNull(), "name").otherwise("new").alias("matched_by"),
    )


def reactivated(resolved: DataFrame, candidates: DataFrame) -> DataFrame:
    """Deleted people that an address match brings back."""
    hits = resolved.filter(F.col("matched_by").isin("sender_email", "document_email"))
    return candidates.filter("deleted").join(hits.select("candidate_id"), "candidate_id", "left_semi")


def assign_new_ids(resolved: DataFrame, incoming: DataFrame, first_id: int) -> DataFrame:
    """Give each new person one id; documents with the same address (or name) share it."""
    keyed = incoming.join(
        resolved.filter(F.col("matched_by") == "new").select("incoming_id"), "incoming_id", "left_semi"
    ).select(
        "incoming_id",
        F.coalesce(
            F.nullif(F.lower("sender_email"), F.lit("")), F.nullif(F.lower("doc_email"), F.lit("")),
            F.lower(F.trim("name")),
        ).alias("person_key"),
    )
    people = ordered_rank(keyed.select("person_key").distinct(), [F.col("person_key")], "__n")
    people = people.select("person_key", (F.col("__n") + first_id - 1).alias("candidate_id"))
    return salted_join(keyed, people, "person_key")


def reconcile_sources(
    left: DataFrame, right: DataFrame, owner: str = "owner", key: str = "company",
    end_month: str = "end_month", tolerance: int = 3, listed: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Match two histories on the lower-cased key; return (merged left rows, flags).

    Several right rows of one key collapse to the one listed last by the column ``listed``, or without it to the
    one with the latest end.
    """
    a = left.withColumn("__key", F.lower(F.coalesce(key, F.lit("")))).withColumn("__left", F.lit(True))
    last = [F.col(listed)] if listed else []
    b = (
        right.withColumn("__key", F.lower(F.coalesce(key, F.lit(""))))
        .groupBy(owner, "__key")
        .agg(F.max_by(F.struct(F.col(key).alias("name"), F.col(end_month).alias("end")),
                      F.struct(*last, F.col(end_month), F.col(key))).alias("__r"))
    )
    both = a.join(b, [owner, "__key"], "full")
    on_left, on_right = F.col("__left").isNotNull(), F.col("__r").isNotNull()
    merged = both.filter(on_left).select(
        owner, key, end_month, on_right.alias("validated"), F.col("__r.name").alias("other_name"))
    gap = month_gap(F.col(end_month), F.col("__r.end"))
    kind = (
        F.when(on_left & on_right & (gap > tolerance), "date_mismatch")
        .when(on_left & ~on_right, "missing_entry").when(~on_left & on_right, "missing_entry")
    )
    flags = (
        both.withColumn("flag_type", kind).filter("flag_type is not null")
        .select(
            owner,
            F.concat(
                F.lit("experience."), F.coalesce(F.col(key), F.col("__r.name"), F.lit("")),
                F.when(F.col("flag_type") == "date_mismatch", ".end_date").otherwise(""),
            ).alias("field"),
            F.when(F.col("flag_type") == "date_mismatch", F.col(end_month)).otherwise(F.col(key)).alias("left_value"),
            F.when(F.col("flag_type") == "date_mismatch", F.col("__r.end"))
            .when(~on_left, F.col("__r.name")).alias("right_value"),
            "flag_type",
        )
    )
    return merged, flags


def calibration_join(evals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Scored evaluations with the owner's outcomes; several outcomes repeat the row."""
    scored = evals.filter(F.col("eval_status").isNull()) if "eval_status" in evals.columns else evals
    if "is_current" in scored.columns:
        scored = scored.filter("is_current")
    return scored.select("candidate_id", "total_score").join(
        outcomes.select("candidate_id", "outcome"), "candidate_id"
    )
