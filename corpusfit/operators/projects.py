"""Evidence from code projects: matching against role rules and claimed skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.operators.sets import skill_tokens

# Words ignored when a rule is compared with a project text.
RULE_STOP_WORDS = ("and", "or", "the", "a", "an", "in", "with", "for", "to", "of", "is", "are")
# Concepts that leave no trace in package names and always count as shown.
CONCEPTS = (
    r"(?i)\b(machine\s*learning|deep\s*learning|natural\s*language|computer\s*vision|problem\s*solv"
    r"|data\s*struct|algorithm|system\s*design|software\s*engineer|agile|scrum|communication|teamwork"
    r"|leadership|oop|object[\s-]oriented|large\s*language|generative\s*ai|llm|rag)\b"
)


def rule_words(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9#+.]+"), 0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*RULE_STOP_WORDS))


def project_match(projects: DataFrame, role_skills: DataFrame, requirements: DataFrame) -> DataFrame:
    """Score each project (project_id, role_id, text) against the skills and rules of its role.

    The rules of a role are a short list, so they travel as one array per role and the
    comparison stays inside the project's row: one keyed join, no pair explosion.
    """
    skills = role_skills.groupBy("role_id").agg(F.array_sort(F.collect_set("skill")).alias("__skills"))
    rules = requirements.groupBy("role_id").agg(
        F.collect_list(F.struct(
            F.lower("label").alias("label"),
            rule_words(F.concat_ws(" ", "label", "description")).alias("words"))).alias("__rules"))
    rows = projects.join(skills, "role_id", "left").join(rules, "role_id", "left").withColumn("__text", F.lower("text")).withColumn(
        "__words", F.array_distinct(F.regexp_extract_all("__text", F.lit(r"[a-z0-9#+.]+"), 0)))
    empty_skills, empty_rules = F.array().cast("array<string>"), F.expr(
        "cast(array() as array<struct<label:string,words:array<string>>>)")
    found = F.filter(F.coalesce("__skills", empty_skills), lambda s: F.contains(F.col("__text"), F.lower(s)))
    met = F.filter(
        F.coalesce("__rules", empty_rules),
        lambda r: (F.size(F.array_intersect(r["words"], F.col("__words"))) >= 2)
        | F.contains(F.col("__text"), r["label"]))
    n_rules, n_skills = F.coalesce(F.size("__rules"), F.lit(0)), F.coalesce(F.size("__skills"), F.lit(0))
    hits = F.when(n_rules > 0, F.size(met)).otherwise(F.size(found))
    wanted = F.when(n_rules > 0, n_rules).otherwise(n_skills)
    return rows.select(
        "project_id", "role_id", found.alias("matched_skills"),
        F.size(met).cast("long").alias("rules_met"),
        F.bround(hits / F.greatest(wanted, F.lit(1)), 2).alias("match_score"))


def project_overall(scored: DataFrame, owners: DataFrame, role_skills: DataFrame) -> DataFrame:
    """Per (owner, role): share of the role's skills shown by any project, and the number not shown."""
    shown = (
        scored.join(owners.select("project_id", "owner"), "project_id")
        .select("owner", "role_id", F.explode_outer("matched_skills").alias("skill"))
        .groupBy("owner", "role_id").agg(F.countDistinct("skill").alias("shown")))
    total = role_skills.groupBy("role_id").agg(F.countDistinct("skill").alias("total"))
    return shown.join(total, "role_id").select(
        "owner", "role_id",
        F.bround(F.col("shown") / F.greatest("total", F.lit(1)) * 100, 0).cast("int").alias("overall_match"),
        (F.col("total") - F.col("shown")).alias("unmatched"))


def cross_reference(
    claims: DataFrame, evidence: DataFrame, activity: DataFrame, min_activity: int = 20
) -> DataFrame:
    """Are claimed skills (owner, skill) visible in the owner's evidence tokens (owner, token)?

    A skill is shown by one of its parts, by its joined form, or when the joined form and a token of at least three
    characters contain one another. The owner's distinct tokens come to each claim as one set, so the work follows
    the owner's own claims and tokens. Owners with little activity or no tokens are not questioned.
    """
    tokens = evidence.groupBy("owner").agg(F.collect_set("token").alias("__tokens"))
    judged = activity.filter(F.col("activity_score") > min_activity).select("owner").distinct().withColumn("__judged", F.lit(True))
    rows = (
        claims.select("owner", "skill").distinct().withColumn("__parts", skill_tokens(F.col("skill")))
        .withColumn("__joined", F.array_join("__parts", ""))
        .join(tokens, "owner", "left").join(judged, "owner", "left"))
    free = F.col("skill").rlike(CONCEPTS) | (F.size("__parts") == 0)
    shown = F.exists("__tokens", lambda t: F.array_contains(F.col("__parts"), t) | (F.length(t) >= 3) & (
        F.contains(F.col("__joined"), t) | F.contains(t, F.col("__joined"))))
    questioned = F.col("__judged").isNotNull() & F.col("__tokens").isNotNull()
    return rows.select("owner", "skill", (~questioned | free | F.coalesce(shown, F.lit(False))).alias("verified"))


def skill_gap_flags(verified: DataFrame) -> DataFrame:
    """Per owner: how many claimed skills lack evidence and how serious that is."""
    from corpusfit.functions.labels import skill_gap_severity

    n = verified.groupBy("owner").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("verified")).alias("unverified"))
    return n.withColumn("severity", skill_gap_severity(F.col("unverified"), F.col("total")))


def relevant_repos(repos: DataFrame, role_skills: DataFrame, pairs: DataFrame) -> DataFrame:
    """Repositories of an owner whose name or description names a skill of the role (owner, role_id), or the reverse.

    The role's skills come as one array to each repository, so nothing is multiplied by skills.
    """
    skills = role_skills.groupBy("role_id").agg(F.array_sort(F.collect_set(F.lower("skill"))).alias("__skills"))
    about = F.col("description") if "description" in repos.columns else F.lit("")
    said = F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce(about, F.lit(""))))
    def named(s):
        return F.contains(F.col("__said"), s) | F.contains(s, F.col("__said"))

    # ``exists`` stops at the first skill; the list is made for rows that stay, and where it is asked for.
    return (
        pairs.select("owner", "role_id").distinct()
        .join(repos.select("owner", "repo_id", "name", said.alias("__said")), "owner").join(skills, "role_id")
        .filter(F.exists("__skills", named))
        .select("owner", "role_id", "repo_id", "name", F.filter("__skills", named).alias("matched_skills")))


def _name_words(name: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", ""), " "), lambda w: w != "")


def unverified_projects(names: DataFrame, relevant: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (owner, role): how many named projects there are, and how many share no word with a relevant repository's name."""
    words = relevant.groupBy("owner", "role_id").agg(F.collect_set("name").alias("__names")).select(
        "owner", "role_id", F.array_distinct(F.flatten(F.transform("__names", _name_words))).alias("__words"))
    rows = pairs.select("owner", "role_id").distinct().join(names.select("owner", "project_name"), "owner").join(
        words, ["owner", "role_id"], "left")
    known = F.coalesce(F.arrays_overlap(_name_words(F.col("project_name")), F.col("__words")), F.lit(False))
    return rows.groupBy("owner", "role_id").agg(
        F.count(F.lit(1)).alias("projects"), F.count_if(~known).alias("unverified"))


def score_modifiers(activity: DataFrame, relevant: DataFrame, unverified: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score change per (owner, role) from activity, relevant repositories and projects nothing speaks for."""
    from corpusfit.functions.labels import rescore_modifier

    count = relevant.groupBy("owner", "role_id").agg(F.count(F.lit(1)).alias("__relevant"))
    rows = pairs.select("owner", "role_id").distinct().join(activity.select("owner", "activity_score"), "owner").join(
        count, ["owner", "role_id"], "left").join(unverified, ["owner", "role_id"], "left")
    zero = F.lit(0)
    return rows.select("owner", "role_id", rescore_modifier(
        F.col("activity_score"), F.coalesce("__relevant", zero), F.coalesce("unverified", zero), F.coalesce("projects", zero)).alias("modifier"))
