"""Sorted pages and first-n-per-group reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfit.scale import by_shuffle

# Columns a result page may be sorted by.
SORTABLE = ("total_score", "project_score", "skill_score", "education_score", "evaluated_at")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group.

    The rank filter makes Spark limit each group inside every input partition first,
    so at most ``n`` rows per group and partition are shuffled, hot group or not.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


#: Rows that may be sorted together for a page; a page that begins later is sought first.
SORTED_AT_ONCE = 10_000
SKETCH = 64
TEXTS_AT_ONCE = 500


def _sought(rows: DataFrame, key: str, offset: int, upto: int, most: int) -> tuple[DataFrame, int]:
    """The rows of a narrow range of ``key`` that holds places ``offset`` to ``upto``, and how many rows come before that range.

    Quantiles of the key give a range, two exact counts confirm it, and it is narrowed again until at most ``most`` rows (or one value) are left.
    Each step reads the rows once and brings ``SKETCH`` numbers to the driver.
    """
    before = 0
    while True:
        told = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx(key, [k / SKETCH for k in range(SKETCH + 1)], 100 * SKETCH).alias("cuts")).first()
        if offset - before >= told.n:  # beyond the last row
            return rows.limit(0), before
        if told.n <= most or told.cuts[0] == told.cuts[-1]:
            return rows, before
        first = max(0, int((offset - before) * SKETCH / told.n) - 1)
        last = min(SKETCH, int((upto - before) * SKETCH / told.n) + 2)
        low, high = told.cuts[first], told.cuts[last]
        value = F.col(key)
        seen = rows.agg(F.count_if(value < low).alias("under"), F.count_if(value <= high).alias("upto")).first()
        # The sketch may be off at the ends: then the range is left open on that side.
        under = seen.under if before + seen.under <= offset else 0
        narrowed = rows if under == 0 and seen.under else rows.where(value >= low)
        if before + seen.upto >= min(upto, before + told.n):
            narrowed = narrowed.where(value <= high)
            kept = seen.upto - under
        else:
            kept = told.n - under
        if kept == told.n:
            return rows, before
        rows, before = narrowed, before + under


def seek_page(
    df: DataFrame, sort_by: str, sort_dir: str = "desc", page: int = 1, limit: int = 20, id_col: str = "evaluation_id",
    most: int = SORTED_AT_ONCE,
) -> DataFrame:
    """A page in order of a number or time (then id), however deep: only a range of about ``most`` rows around it is sorted.

    Unknown values count as the smallest. Rows of equal value are sought by id.
    """
    kind = df.schema[sort_by].dataType.typeName()
    value = F.unix_micros(F.col(sort_by).cast("timestamp")) if kind.startswith("timestamp") else F.col(sort_by)
    value = F.coalesce(value.cast("double"), F.lit(float("-inf")))
    offset = (page - 1) * limit
    keyed = df.withColumn("__key", value if sort_dir == "asc" else -value)
    rows, before = _sought(keyed, "__key", offset, offset + limit, most)
    rows, more = _sought(rows, id_col, offset - before, offset - before + limit, most) if _one_value(rows) else (rows, 0)
    return rows.orderBy("__key", id_col).offset(max(0, offset - before - more)).limit(limit).drop("__key")


def _one_value(rows: DataFrame) -> bool:
    ends = rows.agg(F.min("__key").alias("low"), F.max("__key").alias("high")).first()
    return ends.low is not None and ends.low == ends.high


def sort_page(
    df: DataFrame, sort_by: str = "total_score", sort_dir: str = "desc", page: int = 1,
    limit: int = 20, id_col: str = "evaluation_id", most: int = SORTED_AT_ONCE,
) -> DataFrame:
    """One page in a whitelisted order (unknown names fall back to total_score); id breaks ties.

    A page that ends beyond ``most`` rows is sought (``seek_page``) if its column is a number or a time.
    """
    name = sort_by if sort_by in SORTABLE else "total_score"
    if page * limit > most and df.schema[name].dataType.typeName() != "string":
        return seek_page(df, name, sort_dir, page, limit, id_col, most)
    order = F.desc(name) if sort_dir == "desc" else F.asc(name)
    return df.orderBy(order, id_col).offset((page - 1) * limit).limit(limit)


def page_count(df: DataFrame, limit: int = 20) -> DataFrame:
    """Total rows and number of pages (1 when empty)."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / limit)).cast("long").alias("pages"))


def client_sort(df: DataFrame, key: str, direction: str = "desc", id_col: str = "candidate_id") -> DataFrame:
    """Order by name, matched count, years (unknown = 0) or score."""
    value = {
        "candidate_name": F.lower(F.coalesce("name", F.lit(""))),
        "skills_matched": F.col("skills_matched") if "skills_matched" in df.columns else F.lit(0),
        "years_experience": F.coalesce("years_experience", F.lit(0.0)),
    }.get(key, F.col("total_score") if "total_score" in df.columns else F.lit(0))
    return df.orderBy(value.asc() if direction == "asc" else value.desc(), id_col)


def top_projects(repos: DataFrame, owner: str = "owner", n: int = 8) -> DataFrame:
    """The owner's ``n`` best projects by skill hits, then stars (id breaks ties)."""
    return first_per_group(repos, [owner], [F.desc("hits"), F.desc("stars"), F.asc("repo_id")], n)


def sentences(text: Column) -> Column:
    """Candidate sentences or lines longer than 15 characters."""
    parts = F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) > 15)


def significant_words(skill: Column) -> Column:
    return F.filter(F.split(F.lower(skill), r"\s+"), lambda w: F.length(w) > 2)


def excerpt_of(lines: Column, name: Column, words: Column) -> Column:
    """``best_excerpt`` from prepared sentences, lower-case name and its longer words."""
    whole = F.get(F.filter(lines, lambda s: F.contains(F.lower(s), name)), F.lit(0))
    part = F.get(
        F.filter(lines, lambda s: F.exists(words, lambda w: F.contains(F.lower(s), w))), F.lit(0))
    return F.coalesce(whole, part)


def best_excerpt(text: Column, skill: Column) -> Column:
    """First sentence holding the skill, else any of its longer words."""
    return excerpt_of(sentences(text), F.lower(skill), significant_words(skill))


def _first_line(lower: str, word: str) -> int | None:
    """Number of the first of the joined lower-case sentences, none of which holds a line feed, that holds the word."""
    at = -1 if "\n" in word else lower.find(word)
    return None if at < 0 else lower.count("\n", 0, at)


def _chosen(lines: Sequence[str] | None, lower: str, name: str, words: Sequence[str]) -> str | None:
    if not lines:
        return None
    at = _first_line(lower, name)
    if at is None:
        at = min((k for k in (_first_line(lower, w) for w in words) if k is not None), default=None)
    return None if at is None else lines[at]


def best_excerpts(docs: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``best_excerpt`` for many (key, term) at once: a text meets its terms as one list, is cut into sentences and lower-cased once,
    and is read up to a term's first place."""
    listed = hits.groupBy(key).agg(F.collect_set("term").alias("terms")).select(key, F.transform("terms", lambda t: F.struct(
        t.alias("term"), F.lower(t).alias("name"), significant_words(t).alias("words"))).alias("terms"))
    lines = docs.select(key, sentences(F.col("text")).alias("lines")).withColumn("lower", F.lower(F.array_join("lines", "\n")))
    rows = by_shuffle(lines).join(listed, key).select(key, "lines", "lower", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                owner, terms, found = [], [], []
                for i, (lines, lower, asked) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3)))):
                    owner += [i] * len(asked)
                    terms += [t["term"] for t in asked]
                    found += [_chosen(lines, lower, t["name"], t["words"]) for t in asked]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int32())), pa.array(terms, pa.string()), pa.array(found, pa.string())],
                    names=[key, "term", "excerpt"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, term string, excerpt string")


def top_excerpt(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Excerpt of the best match per group; the first skill in order on ties."""
    return matches.filter(F.col("excerpt").isNotNull()).groupBy(*keys).agg(
        F.max_by("excerpt", F.struct("score", -F.col("position"))).alias("top_excerpt"))


def _joined_first(rows: DataFrame, keys: Sequence[str], order: Column, n: int, out: str) -> DataFrame:
    kept = first_per_group(rows, keys, [order, F.asc("skill")], n)
    return kept.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.lit(0).alias("z"), "position", "skill"))),
                        lambda x: x["skill"]), ", ").alias(out))


def strengths_gaps(
    matches: DataFrame, gaps: DataFrame, key: str = "evaluation_id", n_strong: int = 5, n_gap: int = 3
) -> DataFrame:
    """First matched skills and first gaps per evaluation, in list order."""
    strong = _joined_first(matches, [key], F.asc("position"), n_strong, "strengths")
    weak = _joined_first(gaps, [key], F.asc("position"), n_gap, "gaps")
    return strong.join(weak, key, "full")


def weakest_strongest(scores: DataFrame, key: str, low: float = 40, high: float = 80) -> DataFrame:
    """Lowest item under ``low`` and highest item from ``high`` up per group."""
    out = scores.groupBy(key).agg(
        F.min_by(F.struct("label", "score"), F.struct("score", "position")).alias("__w"),
        F.max_by(F.struct("label", "score"), F.struct("score", "position")).alias("__s"),
    )
    return out.select(
        key, F.when(F.col("__w.score") < low, F.col("__w.label")).alias("weakest"),
        F.when((F.col("__s.score") >= high) & (F.col("__s.label") != F.col("__w.label")), F.col("__s.label"))
        .alias("strongest"))
