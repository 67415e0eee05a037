"""Per-key "newest", running and ranked rows, written as mergeable aggregates where possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfit.functions.text import merged_years
from corpusfit.scale import ordered_rank, salted_join

LOG_ORDER = ("changed_at", "seq", "ref_a", "ref_b")


def latest_status(
    log: DataFrame, key: str = "evaluation_id", order: Sequence[str] = LOG_ORDER,
    values: Sequence[str] = ("status",),
) -> DataFrame:
    """Newest log row per key. ``max_by`` merges map-side, so a hot key never lands in one sort."""
    newest = F.struct(*order)
    picked = F.max_by(F.struct(*values, order[0]), newest).alias("__last")
    return log.groupBy(key).agg(picked).select(
        key, *[F.col(f"__last.{v}").alias(f"latest_{v}") for v in values],
        F.col(f"__last.{order[0]}").alias(f"latest_{order[0]}"),
    )


def latest_role_per_owner(evals: DataFrame, owner: str = "candidate_id") -> DataFrame:
    """Newest evaluation and its role for each owner (id breaks ties)."""
    return evals.groupBy(owner).agg(
        F.max_by(F.struct("evaluation_id", "role_id"), F.struct("evaluated_at", "evaluation_id")).alias("__e")
    ).select(owner, "__e.*")


def current_version(versions: DataFrame, owner: str = "candidate_id") -> DataFrame:
    """Set ``is_current`` on the newest version of each owner and clear it on the others."""
    newest = versions.groupBy(owner).agg(
        F.max_by("version_id", F.struct("uploaded_at", "version_id")).alias("__newest")
    )
    return (
        salted_join(versions.drop("is_current"), newest, owner)
        .withColumn("is_current", F.col("version_id") == F.col("__newest")).drop("__newest")
    )


def global_rank(
    df: DataFrame, order: Sequence[Column], group_col: str | None = None,
    group_order: Sequence[str] = ("executive", "senior", "mid", "junior", "entry"),
) -> DataFrame:
    """Running rank over all pages, optionally level by level in a fixed order."""
    if group_col is None:
        return ordered_rank(df, order)
    place = F.array_position(F.array(*[F.lit(g) for g in group_order]), F.coalesce(group_col, F.lit("entry")))
    return ordered_rank(df.withColumn("__group", place), [F.col("__group"), *order]).drop("__group")


def experience_years(ranges: DataFrame, owner: str = "owner") -> DataFrame:
    """Years covered by the union of an owner's spans; touching spans merge.

    Spans are first reduced to the longest one per start year (merges map-side and
    leaves at most one row per calendar year), so the sorted fold per owner is short
    even when one owner has most of the rows.
    """
    longest = (
        ranges.filter(F.col("start_year") <= F.col("end_year"))
        .groupBy(owner, "start_year").agg(F.max("end_year").alias("end_year"))
    )
    spans = longest.groupBy(owner).agg(
        F.collect_list(F.struct("start_year", "end_year")).alias("spans"))
    return spans.select(owner, merged_years(F.col("spans")).alias("years"))


def burst_window(
    df: DataFrame, key: str, ts: str, seconds: int, max_n: int
) -> DataFrame:
    """Requests of the same key within the last ``seconds`` (inclusive) at each stamp, and a flag.

    Rows are counted per (key, stamp) first; each key is then cut into time slots of
    one window length, and a slot also sees the slot before it. A hot key is thus
    handled by many tasks and no slot looks further back than it must.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    counted = (
        df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__t", micros).withColumn("__slot", F.floor(F.col("__t") / span))
    )
    seen = counted.withColumn("__late", F.explode(F.array(F.lit(0), F.lit(1))))
    seen = seen.withColumn("__home", F.col("__slot") + F.col("__late"))
    w = Window.partitionBy(key, "__home").orderBy("__t").rangeBetween(-span, 0)
    counts = (
        seen.withColumn("in_window", F.sum("__n").over(w)).filter(F.col("__late") == 0)
        .select(key, ts, F.col("__n").alias("at_stamp"), "in_window")
    )
    return counts.withColumn("over_limit", F.col("in_window") > max_n)
