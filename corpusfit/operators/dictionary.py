"""Which dictionary terms occur in which texts, by looked-up windows and equi-joins instead of text x term loops."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.scale import spread

ANCHOR = 4
#: Lists up to this length travel to the tasks; longer ones meet the texts by joins.
IN_TASK = 20_000
TEXTS_AT_ONCE, PLACES_AT_ONCE = 500, 1 << 19
WINDOW = 8


def _windows(text: Column) -> Column:
    """Distinct character windows of 1 to ``ANCHOR`` characters, found in one pass over the text per length."""
    return F.array_distinct(F.concat(*[
        F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, ANCHOR + 1)]))


def contained_terms(texts: DataFrame, terms: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(text_id, term) for every term that is a substring of the text.

    A list of at most ``in_task`` terms goes to the tasks, where a text is read once for all of them; a longer list
    meets the texts by joins.
    """
    wanted = terms.select("term").distinct().filter(F.length("term") > 0)
    listed = [r.term for r in wanted.limit(in_task + 1).collect()]
    if len(listed) > in_task:
        return _contained_by_join(texts, wanted)
    names = sorted(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, table = [t.encode() for t in names], pa.array(names, pa.string())
        tables = _window_tables(spelled)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                owner, found = _held([(t or "").encode() for t in part.column(1).to_pylist()], spelled, tables)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), table.take(pa.array(found))], names=["text_id", "term"])

    kind = texts.schema["text_id"].dataType.simpleString()
    return spread(texts.select("text_id", "text")).mapInArrow(run, f"text_id {kind}, term string")


def _mixed(windows: np.ndarray) -> np.ndarray:
    """16 bits of each window of up to ``WINDOW`` bytes."""
    return (windows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def _window_tables(terms: Sequence[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By window size: which mixed windows may begin a term, the sorted first windows, and their terms in that order.

    A term's window is the whole term, or its first ``WINDOW`` bytes.
    """
    tables = {}
    for n in sorted({min(len(t), WINDOW) for t in terms}):
        mine = [k for k, t in enumerate(terms) if min(len(t), WINDOW) == n]
        firsts = np.array([int.from_bytes(terms[k][:n], "big") for k in mine], np.uint64)
        order = np.argsort(firsts, kind="stable")
        may = np.zeros(1 << 16, bool)
        may[_mixed(firsts)] = True
        tables[n] = may, firsts[order], np.array(mine, np.int64)[order]
    return tables


def _held(texts: Sequence[bytes], terms: Sequence[bytes], tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) places of all terms that the texts hold; whole terms longer than a window are confirmed in their text."""
    ends = np.cumsum([len(t) for t in texts])
    joined = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    seen = np.zeros((len(texts), len(terms)), bool)
    for at in range(0, len(joined) - WINDOW, PLACES_AT_ONCE):
        size = min(PLACES_AT_ONCE, len(joined) - WINDOW - at)
        windows = np.zeros(size, np.uint64)
        for n in range(1, max(tables, default=0) + 1):
            windows = (windows << np.uint64(8)) | joined[at + n - 1:at + n - 1 + size]
            if n not in tables:
                continue
            may, firsts, mine = tables[n]
            place = np.flatnonzero(may[_mixed(windows)])
            low, high = (np.searchsorted(firsts, windows[place], side) for side in ("left", "right"))
            # A window that begins several terms counts for each.
            several = high - low
            place, first = np.repeat(place, several), np.repeat(low, several)
            which = mine[first + np.arange(len(first)) - np.repeat(np.cumsum(several) - several, several)]
            owner = np.searchsorted(ends, place + at, "right")
            whole = place + at + n <= ends[owner]
            seen[owner[whole], which[whole]] = True
    owner, which = np.nonzero(seen)
    long = np.array([len(t) > WINDOW for t in terms], bool)
    sure = [not x or terms[k] in texts[i] for i, k, x in zip(owner, which, long[which])] if long.any() else slice(None)
    return owner[sure], which[sure]


def _contained_by_join(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``contained_terms`` for lists of any length.

    Each term is filed under its first ``ANCHOR`` characters (all of them when it is shorter). A text offers its
    windows, so a term that occurs always meets its text on that key. Texts are looked at again just for candidates that
    are longer than the window.
    """
    keyed = wanted.select("term", F.substring("term", 1, ANCHOR).alias("__anchor"))
    # explode_outer: the inner form would make the windows a second time, to drop texts without any
    offered = spread(texts).select("text_id", F.explode_outer(_windows(F.col("text"))).alias("__anchor"))
    met = offered.join(keyed, "__anchor")
    sure = met.filter(F.col("term") == F.col("__anchor")).select("text_id", "term")
    longer = met.filter(F.col("term") != F.col("__anchor")).select("text_id", "term")
    return sure.unionByName(_verified(texts.select("text_id", "text"), longer, F.contains))


def _verified(texts: DataFrame, open_pairs: DataFrame, present) -> DataFrame:
    """Keep (text_id, term) candidates that ``present(text, term)`` confirms.

    A text's candidates come to it as one list and are looked for in its own row, so a text is copied once, whatever their number.
    """
    listed = open_pairs.groupBy("text_id").agg(F.collect_set("term").alias("__terms"))
    return texts.join(listed, "text_id").select(
        "text_id", F.explode_outer(F.filter("__terms", lambda t: present(F.col("text"), t))).alias("term")).filter("term is not null")


def words_of(text: Column, pattern: str = r"(?U)\w+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def ngrams(words: Column, n: int, sep: str = " ") -> Column:
    """All runs of ``n`` words."""
    last = F.size(words) - n
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                    lambda i: F.array_join(F.slice(words, i + 1, n), sep)),
    ).otherwise(F.array().cast("array<string>"))


def bounded_terms(texts: DataFrame, terms: DataFrame, edge: str = "[a-z0-9]", token: bool = False) -> DataFrame:
    """(text_id, term) for every term found with no ``edge`` character on either side.

    Candidates come from an equi-join of the text's distinct character runs with the first
    run of each term. A term that is just that run is thereby found; for others, such as
    "c++" or "node.js", the exact boundary rule is checked on the whole text.
    With ``token`` both ends must be word boundaries instead.
    """
    run = r"(?U)\w+" if token else edge + "+"
    lower = texts.select("text_id", F.lower("text").alias("text"))
    keyed = terms.select(F.lower("term").alias("term")).distinct().withColumn(
        "__head", F.regexp_extract("term", run, 0))
    heads = F.array_distinct(F.regexp_extract_all("text", F.lit(run), 0))
    offered = spread(lower).select("text_id", F.explode_outer(heads).alias("__head"))
    met = offered.join(keyed.filter("__head <> ''"), "__head")

    def present(text: Column, term: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), term, F.lit("\\E"))
        bounded = (
            F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b")) if token
            else F.concat(F.lit(f"(?<!{edge})"), quoted, F.lit(f"(?!{edge})")))
        return F.contains(text, term) & F.regexp_like(text, bounded)

    sure = met.filter(F.col("term") == F.col("__head")).select("text_id", "term")
    # Texts are shuffled to their candidates only where the list has terms that need a look at the whole text.
    more = {r.kind for r in keyed.filter("term <> __head").select((F.col("__head") == "").alias("kind")).distinct().collect()}
    if False in more:
        open_pairs = met.filter(F.col("term") != F.col("__head")).select("text_id", "term")
        sure = sure.unionByName(_verified(lower, open_pairs, present))
    if True in more:
        odd = contained_terms(lower, keyed.filter("__head = ''").select("term"))
        sure = sure.unionByName(_verified(lower, odd, present))
    return sure


def dictionary_match(texts: DataFrame, terms: DataFrame, mode: str = "word") -> DataFrame:
    """Terms found in texts (case-insensitive).

    ``word``: no letter or digit of a-z0-9 next to the term; ``token``: word boundary at
    both ends; ``substring``: anywhere.
    """
    if mode == "substring":
        lower = texts.select("text_id", F.lower("text").alias("text"))
        return contained_terms(lower, terms.select(F.lower("term").alias("term")))
    return bounded_terms(texts, terms, token=mode == "token")


def jd_skills(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(text_id, skill): skills named in role texts, by name or by another spelling (term -> skill)."""
    found = dictionary_match(texts, known.select("term"))
    table = known.select(F.lower("term").alias("term"), "skill").distinct()
    return found.join(table, "term").select("text_id", "skill").distinct()


def known_skill_terms(spark) -> DataFrame:
    """Built-in names and spellings as a (term, skill, category) table."""
    from corpusfit.functions import lists

    names = [(n.lower(), n, kind) for kind, group in lists.KNOWN_SKILLS for n in group]
    category = {n: kind for _, n, kind in names}
    alias = [(a, n, category.get(n, "skill")) for a, n in lists.JD_ALIASES.items()]
    return spark.createDataFrame(names + alias, "term string, skill string, category string")
