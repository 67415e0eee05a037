"""Table upkeep: each job returns the new snapshot of a table, plus audit rows where kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.functions import labels, lists
from corpusfit.functions.text import extract_name, graduation_year, level_from_text, name_from_email
from corpusfit.plans.segment import segment
from corpusfit.scale import salted_join

ERASED_NAME = "Deleted User"


def _marked(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Add ``__hit``: the key is in ``ids``. Keys are unique on the id side; hot fact keys are salted."""
    return salted_join(df, ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left").withColumn(
        "__hit", F.coalesce("__hit", F.lit(False)))


def soft_delete(df: DataFrame, ids: DataFrame, as_of: str, key: str = "candidate_id") -> DataFrame:
    """Set ``deleted_at`` for listed rows that are not deleted yet."""
    now = F.to_timestamp_ntz(F.lit(as_of))
    hit = F.col("__hit") & F.col("deleted_at").isNull()
    return _marked(df, ids, key).withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at"))).drop("__hit")


def restore(df: DataFrame, ids: DataFrame, key: str = "candidate_id") -> DataFrame:
    return _marked(df, ids, key).withColumn(
        "deleted_at", F.when(~F.col("__hit"), F.col("deleted_at"))).drop("__hit")


def deletion_audit(before: DataFrame, after: DataFrame, key: str = "candidate_id") -> DataFrame:
    """One audit row per record whose deletion mark changed."""
    old = before.select(key, F.col("deleted_at").alias("__old"))
    return after.select(key, "deleted_at").join(old, key).filter(
        ~F.col("deleted_at").eqNullSafe(F.col("__old"))
    ).select(F.col(key).alias("target_id"), F.when(F.col("deleted_at").isNull(), "restore").otherwise("soft_delete").alias("action"))


def cascade_delete(
    tables: Mapping[str, DataFrame], ids: DataFrame, links: Sequence[tuple[str, str, str, str]], root: str, key: str
) -> dict[str, DataFrame]:
    """Drop listed root rows and everything that points to them.

    ``links`` are (child table, child column, parent table, parent column) in parent-first order.
    """
    gone = {root: tables[root].join(ids.select(key).distinct(), key, "left_semi")}
    out = {root: tables[root].join(ids.select(key).distinct(), key, "left_anti")}
    for child, column, parent, parent_column in links:
        dead = gone[parent].select(F.col(parent_column).alias(column)).distinct()
        gone[child] = tables[child].join(dead, column, "left_semi")
        out[child] = tables[child].join(dead, column, "left_anti")
    return out


def erase_subject(
    candidates: DataFrame, documents: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove personal data of listed people but keep rows and scores; returns (people, documents, audit)."""
    personal = [c for c in ("email", "phone", "title", "github_url", "linkedin_url", "portfolio_url") if c in candidates.columns]
    people = _marked(candidates, ids, "candidate_id")
    for c in personal:
        people = people.withColumn(c, F.when(~F.col("__hit"), F.col(c)))
    people = people.withColumn("name", F.when(F.col("__hit"), ERASED_NAME).otherwise(F.col("name")))
    content = [c for c in ("text", "sections", "excerpts", "fp") if c in documents.columns]
    docs = _marked(documents, ids, "candidate_id")
    for c in content:
        docs = docs.withColumn(c, F.when(~F.col("__hit"), F.col(c)))
    audit = people.filter("__hit").select(F.col("candidate_id").alias("target_id"), F.lit("privacy_erase").alias("action"))
    return people.drop("__hit"), docs.drop("__hit"), audit


def reclassify_levels(candidates: DataFrame, as_of_year: int) -> DataFrame:
    """New level for everyone and whether it changed."""
    c = F.col
    new = labels.level_from_years(
        c("years_experience"), c("graduation_year"), level_from_text(F.coalesce("title", F.lit(""))), as_of_year)
    return candidates.withColumn("__new", new).withColumn(
        "changed", ~c("__new").eqNullSafe(c("level"))).withColumn("level", c("__new")).drop("__new")


def resegment_all(docs: DataFrame) -> DataFrame:
    """Sections of every stored text that is present."""
    return segment(docs.filter("text is not null and text <> ''"))


def reparse_all(docs: DataFrame, candidates: DataFrame, as_of_year: int) -> DataFrame:
    """Name and graduation year read again from the current text of everyone not deleted."""
    c = F.col
    edu = segment(docs).filter("type = 'education'").groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "text"))), lambda s: s["text"]), "\n|\n").alias("__edu"))
    read = docs.join(edu, "doc_id", "left").select(
        c("doc_id").alias("candidate_id"), extract_name(c("text")).alias("__name"),
        graduation_year(c("__edu"), c("text"), as_of_year).alias("__year"))
    rows = candidates.filter(~F.coalesce("deleted", F.lit(False))).join(read, "candidate_id", "left")
    return rows.withColumn("name_changed", F.coalesce(c("__name") != c("name"), F.lit(False))).withColumn(
        "name", F.coalesce("__name", "name")).withColumn(
        "graduation_year", F.coalesce("__year", "graduation_year")).drop("__name", "__year")


def repair_names(candidates: DataFrame, headings: Sequence[str] = lists.HEADING_PHRASES) -> DataFrame:
    """Names that are section headings become the address's local part, or Unknown."""
    bad = F.lower("name").isin(*headings)
    better = F.coalesce(F.when(F.col("email") != "", name_from_email(F.col("email"))), F.lit("Unknown"))
    return candidates.withColumn("name", F.when(bad, better).otherwise(F.col("name")))


def bulk_status(evals: DataFrame, ids: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """New log rows for known ids, and the ids that do not exist."""
    wanted = ids.select("evaluation_id").distinct()
    known = wanted.join(evals.select("evaluation_id"), "evaluation_id", "left_semi")
    missing = wanted.join(evals.select("evaluation_id"), "evaluation_id", "left_anti")
    return known.withColumn("status", F.lit(status)), missing


def manual_override(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest manual score per evaluation (stored rows count as older)."""
    both = existing.withColumn("__age", F.lit(0)).unionByName(incoming.withColumn("__age", F.lit(1)))
    values = [c for c in existing.columns if c != "evaluation_id"]
    return both.groupBy("evaluation_id").agg(
        F.max_by(F.struct(*values), F.struct("__age", "scored_at", "manual_score")).alias("__v")
    ).select("evaluation_id", "__v.*")


def effective_scores(evals: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual score where there is one, else the computed one."""
    return evals.join(manual.select("evaluation_id", "manual_score"), "evaluation_id", "left").withColumn(
        "effective_score", F.coalesce("manual_score", "total_score"))


def archive_version(
    versions: DataFrame, candidates: DataFrame, ids: DataFrame, as_of: str
) -> tuple[DataFrame, DataFrame]:
    """Archive versions; owners point to their newest other current one or are soft-deleted.

    Returns (versions, owners touched with ``current_version_id`` and ``deleted_at``).
    """
    marked = _marked(versions, ids, "version_id")
    after = marked.withColumn("is_current", F.col("is_current") & ~F.col("__hit"))
    touched = after.groupBy("candidate_id").agg(
        F.bool_or("__hit").alias("__touched"),
        F.max_by(F.when(F.col("is_current"), F.col("version_id")),
                 F.when(F.col("is_current"), F.struct("uploaded_at", "version_id"))).alias("current_version_id"),
    ).filter("__touched")
    now = F.to_timestamp_ntz(F.lit(as_of))
    owners = candidates.select("candidate_id").join(touched, "candidate_id").select(
        "candidate_id", "current_version_id",
        F.when(F.col("current_version_id").isNull(), now).alias("deleted_at"))
    return after.drop("__hit"), owners


def purge_landing(landing: DataFrame, ids: DataFrame | None = None, statuses: Sequence[str] = ()) -> DataFrame:
    """Reset listed messages to new without error, and drop rows of the given states."""
    out = landing
    if ids is not None:
        out = _marked(out, ids, "message_id").withColumn(
            "status", F.when(F.col("__hit"), "new").otherwise(F.col("status"))).withColumn(
            "error", F.when(~F.col("__hit"), F.col("error"))).drop("__hit")
    return out.filter(~F.col("status").isin(*statuses)) if statuses else out


def replace_rules(rules: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rules of each incoming role replace the stored ones.

    Written with ``partitionOverwriteMode=dynamic`` and ``partitionBy("role_id")`` only the
    roles that changed are rewritten.
    """
    return rules.join(incoming.select("role_id").distinct(), "role_id", "left_anti").unionByName(incoming)


def write_rules(incoming: DataFrame, path: str) -> None:
    incoming.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("role_id").parquet(path)


def changed_count(rows: DataFrame, flag: Column) -> DataFrame:
    return rows.agg(F.count_if(flag).alias("updated"), F.count(F.lit(1)).alias("total"))
