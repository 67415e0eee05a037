"""Set comparisons and unions of partial sources."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.functions.text import bound


def compare_pairs(
    pairs: DataFrame, evals: DataFrame, matches: DataFrame, gaps: DataFrame
) -> DataFrame:
    """Compare evaluations a and b of each pair: shared and single-sided skills, gaps, better one.

    Works for any number of pairs at once: both sides' skills meet on (pair, skill).
    """
    sides = pairs.select("a", "b", F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col("a").alias("evaluation_id")),
        F.struct(F.lit(2).alias("side"), F.col("b").alias("evaluation_id")))).alias("__s")
    ).select("a", "b", "__s.*")
    seen = (
        sides.join(matches.select("evaluation_id", "skill").distinct(), "evaluation_id")
        .groupBy("a", "b", "skill").agg(F.sum("side").alias("where"))
        .groupBy("a", "b").agg(
            F.count_if(F.col("where") == 3).alias("shared_count"),
            F.count_if(F.col("where") == 1).alias("only_a_count"),
            F.count_if(F.col("where") == 2).alias("only_b_count"))
    )
    missing = (
        sides.join(gaps.select("evaluation_id", "skill"), "evaluation_id").groupBy("a", "b").agg(
            F.count_if(F.col("side") == 1).alias("gaps_a"), F.count_if(F.col("side") == 2).alias("gaps_b"))
    )
    score = evals.select("evaluation_id", "total_score")
    scored = (
        pairs.join(score.toDF("a", "score_a"), "a").join(score.toDF("b", "score_b"), "b")
    )
    return (
        scored.join(seen, ["a", "b"], "left").join(missing, ["a", "b"], "left")
        .na.fill(0, ["shared_count", "only_a_count", "only_b_count", "gaps_a", "gaps_b"])
        .select(
            "a", "b", "shared_count", "only_a_count", "only_b_count", "gaps_a", "gaps_b",
            F.when(F.col("score_a") >= F.col("score_b"), F.col("a")).otherwise(F.col("b")).alias("best_pick"),
            F.bround(F.abs(F.col("score_a") - F.col("score_b")), 1).alias("score_diff"))
    )


def compare_pair(evals: DataFrame, matches: DataFrame, gaps: DataFrame, a: int, b: int) -> DataFrame:
    """Compare two given evaluations."""
    pair = evals.sparkSession.range(1).select(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
    return compare_pairs(pair, evals, matches, gaps)


def union_skill_sources(
    sources: Sequence[DataFrame], existing: DataFrame, keys: Sequence[str] = ("text_id",)
) -> DataFrame:
    """Merge skill finds of several sources; earlier sources win for name and required flag.

    Each source has the keys, ``skill`` and ``is_required``. The last source may refine
    ``refines = true``. Skills unknown to ``existing`` get a null id and ``is_new``.

    Finds of one owner that follow one another travel as one row, and are merged in the owner's row.
    """
    stacked = None
    for priority, source in enumerate(sources):
        part = source.select(
            *keys, F.lit(priority).alias("priority"),
            F.coalesce(F.col("refines") if "refines" in source.columns else F.lit(False), F.lit(False)).alias("refines"), "skill", "is_required")
        stacked = part if stacked is None else stacked.unionByName(part)
    runs = _packed_runs(stacked, len(keys) + 2).repartition(*keys).groupBy(*keys).agg(
        F.collect_list(F.struct("priority", "refines", "skill", "is_required")).alias("__runs"))
    finds = F.flatten(F.transform("__runs", lambda r: F.transform(r["skill"], lambda s, i: F.struct(
        F.lower(s).alias("key"), r["priority"].alias("priority"), s.alias("skill"), F.get(r["is_required"], i).alias("is_required"), r["refines"].alias("refines")))))
    packed = runs.select(*keys, F.array_sort(finds).alias("__finds"))
    merged = packed.select(*keys, F.inline(bound(F.col("__finds"), _merged))).withColumnRenamed("key", "__key")
    known = existing.select(F.lower("skill").alias("__key"), "skill_id").groupBy("__key").agg(
        F.min("skill_id").alias("skill_id"))
    return merged.join(known, "__key", "left").withColumn("is_new", F.col("skill_id").isNull()).drop("__key")


def _packed_runs(rows: DataFrame, n_keys: int) -> DataFrame:
    """Rows that follow one another with the same keys, which are the first columns, as one row: each other column is an array."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names, kinds = rows.columns, [f.dataType.simpleString() for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows - 1, bool)
            for column in batch.columns[:n_keys]:
                same = pc.fill_null(pc.equal(column[1:], column[:-1]), False)
                new |= ~(same.to_numpy(zero_copy_only=False) | pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1])).to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                *(c.take(pa.array(starts)) for c in batch.columns[:n_keys]),
                *(pa.ListArray.from_arrays(offsets, c) for c in batch.columns[n_keys:])], names=names)

    return rows.mapInArrow(run, ", ".join(
        f"`{name}` {kind if k < n_keys else f'array<{kind}>'}" for k, (name, kind) in enumerate(zip(names, kinds))))


def _merged(finds: Column) -> Column:
    """(key, skill, is_required) per key of an owner's finds, which are sorted by key and priority: the first one's, and the last refined flag."""
    first = F.filter(F.sequence(F.lit(1), F.size(finds)), lambda i: (i == 1) | ~F.get(finds, i - 1)["key"].eqNullSafe(F.get(finds, i - 2)["key"]))

    def verdict(mine):
        refined = F.filter(mine, lambda x: x["refines"])
        return F.struct(
            F.get(mine, F.lit(0))["key"].alias("key"), F.get(mine, F.lit(0))["skill"].alias("skill"),
            F.coalesce(F.try_element_at(refined, F.lit(-1))["is_required"], F.get(mine, F.lit(0))["is_required"]).alias("is_required"))

    return bound(first, lambda at: F.transform(at, lambda i, k: bound(
        F.slice(finds, i, F.coalesce(F.get(at, k + 1), F.size(finds) + 1) - i), verdict)))


def union_projects(code: DataFrame, pages: DataFrame) -> DataFrame:
    """Repository projects and page headings in one schema."""
    a = code.withColumn("source", F.lit("github"))
    b = pages.withColumn("source", F.lit("portfolio")).withColumn("name", F.col("description"))
    return a.unionByName(b, allowMissingColumns=True)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Case-insensitive distinct values per group, keeping the first spelling."""
    return df.groupBy(*keys, F.lower(value).alias("__key")).agg(
        F.min_by(value, F.struct(order, value)).alias(value), F.min(order).alias(order)).drop("__key")


def skill_tokens(name: Column) -> Column:
    """Lower-case parts of at least three characters with symbols removed."""
    parts = F.filter(F.split(F.lower(name), r"[\s\-_./]+"), lambda p: F.length(p) >= 3)
    return F.transform(parts, lambda p: F.regexp_replace(p, "[^a-z0-9]", ""))


def vocab_union(sources: Sequence[DataFrame], owner: str = "owner") -> DataFrame:
    """Distinct evidence tokens per owner from several (owner, term) sources."""
    stacked = None
    for source in sources:
        part = source.select(owner, F.explode(skill_tokens(F.col("term"))).alias("token"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.filter("token <> ''").distinct()
