"""The ranked board: evaluations with owner, role, matched skills and state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfit.functions import labels
from corpusfit.operators.filters import active_current
from corpusfit.operators.topk import sort_page
from corpusfit.scale import cut_lineage
from corpusfit.operators.windows import latest_status


def board_rows(evals: DataFrame, versions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Evaluations with version and owner columns (the base of every board query)."""
    return evals.join(versions.select("version_id", "is_current"), "version_id").join(
        candidates.select(
            "candidate_id", "name", "email", "stage", "level", "years_experience", "graduation_year",
            "needs_review", "deleted", "github_url"), "candidate_id")


def leaderboard(
    evals: DataFrame, versions: DataFrame, candidates: DataFrame, roles: DataFrame,
    role_skills: DataFrame, matches: DataFrame, status_log: DataFrame,
    filters: Mapping[str, object] | None = None, search: str | None = None,
    sort_by: str = "total_score", sort_dir: str = "desc", page: int = 1, limit: int = 20,
) -> DataFrame:
    """One page of the board.

    The page is cut before the matched skills and the log are joined, because neither
    changes which rows are shown: only ``limit`` rows go through those joins. It is written once for all of them.
    """
    rows = active_current(board_rows(evals, versions, candidates))
    for name, value in (filters or {}).items():
        rows = rows.filter(F.col(name) == F.lit(value))
    if search and search.strip():
        needle = search.strip().lower()
        rows = rows.filter(
            F.coalesce(F.lower("name").contains(needle), F.lit(False))
            | F.coalesce(F.lower("email").contains(needle), F.lit(False)))
    shown = F.broadcast(cut_lineage(sort_page(rows, sort_by, sort_dir, page, limit)))
    ids = shown.select("evaluation_id")
    last = latest_status(status_log.join(F.broadcast(ids), "evaluation_id", "left_semi"))
    found = matches.join(F.broadcast(ids), "evaluation_id", "left_semi").groupBy("evaluation_id").agg(
        F.count(F.lit(1)).alias("skills_matched"))
    wanted = role_skills.groupBy("role_id").agg(F.count(F.lit(1)).alias("skills_total"))
    c = F.col
    return (
        shown.join(roles.select("role_id", F.col("title").alias("role_title"), "require_github"), "role_id")
        .join(last.select("evaluation_id", "latest_status"), "evaluation_id", "left")
        .join(found, "evaluation_id", "left").join(wanted, "role_id", "left")
        .select(
            "evaluation_id", "candidate_id", c("name").alias("candidate_name"), "email", "level",
            "role_id", "role_title", "total_score", "project_score", "skill_score", "education_score",
            F.coalesce("skills_matched", F.lit(0).cast("long")).alias("skills_matched"),
            F.coalesce("skills_total", F.lit(0).cast("long")).alias("skills_total"),
            labels.project_band(c("project_score")).alias("project_match_label"),
            labels.derive_status(c("stage"), c("latest_status"), c("needs_review"), c("eval_status")).alias("status"),
            labels.filter_stage(c("eval_status")).alias("filter_stage"),
            labels.missed_requirement(c("require_github"), c("github_url")).alias("missed_requirement"),
            "evaluated_at")
    )
