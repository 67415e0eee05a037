"""Quality rules whose failures are also judged by host, with column functions only.

Per document: word and line counts and the base rule (few words, or many repeated five-word windows), and further
single rules. Per host: how many documents fail each rule. A host's failure rate is shrunk towards that of all documents
with a beta prior that is fitted to the counts (beta-binomial moments from pairs of documents, hosts weighted by documents,
so without the sampling noise of the rates), so a host with few documents is judged mostly by the prior. A host fails when a shrunk rate has odds
of ``times_mean`` those of the prior mean and at least ``least_rate``, or is over ``greatest_limit`` in any case; the
verdict is joined back to its documents. ``rate_*`` are the shrunk rates that are judged.

Counts are pre-aggregated in the map tasks, so a host with a third of all documents is one row per task.

Defined cases: a null text has no words and fails the base rule; documents without a host are judged on their own; repeated rows count as
often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.scale import cut_lineage

SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    least_words: int = 10
    repeat_percent: int = 20
    symbol_percent: int = 10
    dup_line_percent: int = 30
    least_mean_word: float = 2.0
    greatest_mean_word: float = 12.0
    #: A host fails a rule at this many times the odds of the prior mean, and at no less than the given rate.
    times_mean: float = 3.0
    least_rate: float = 0.5
    #: No limit is higher, however many hosts are bad.
    greatest_limit: float = 0.9


def _counts(docs: DataFrame, host: str) -> DataFrame:
    """Word counts by document; every step is one projection over arrays in the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    start = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), text.alias("text"),
        F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"))
    count = F.size("words")
    # Hash of every window with its place: one sort brings equal windows together.
    windows = F.when(count >= WINDOW, F.transform(
        F.sequence(F.lit(0), count - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    hashed = start.select(
        "doc_id", "host", count.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), windows.alias("windows"))
    placed = hashed.withColumn("sorted", F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def again(value: Column, i: Column) -> Column:
        return F.coalesce(value["h"] == F.get(F.col("sorted"), i - 1)["h"], F.lit(False)) | F.coalesce(
            value["h"] == F.get(F.col("sorted"), i + 1)["h"], F.lit(False))

    repeated = placed.withColumn("starts", F.sort_array(F.transform(F.filter("sorted", again), lambda v: v["i"])))
    covered = F.aggregate(
        F.transform("starts", lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda total, n: total + n)
    return repeated.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", covered.cast("long").alias("n_repeat_words"))


def failures(rules: Rules) -> dict[str, Column]:
    """Rules by name; true where a document fails."""
    words = F.col("n_words")
    return {
        "short": words < rules.least_words,
        "repeats": 100 * F.col("n_repeat_words") > rules.repeat_percent * words,
        "symbols": 100 * F.col("n_symbols") > rules.symbol_percent * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > rules.dup_line_percent * F.col("n_lines"),
        "word_length": (F.col("word_chars") < rules.least_mean_word * words) | (F.col("word_chars") > rules.greatest_mean_word * words),
    }


def _beta_binomial(hosts: int, docs: float, failed: int, pairs: float) -> tuple[float, float]:
    """Mean and strength of the prior from ``pairs``, the sum of ``failed * (failed - 1) / docs`` over hosts.

    Two documents of a host fail together with ``mean ** 2`` and a share ``alike`` of ``mean * (1 - mean)``; pairs hold no
    sampling noise, and hosts of one document have none. Without pairs, or where they do not fail together, the prior is
    as strong as a million documents; it is never weaker than two, so that no single document fails its host.
    """
    mean = failed / docs if docs else 0.0
    alone = mean * (1 - mean)
    alike = (pairs / (docs - hosts) - mean * mean) / alone if docs > hosts and alone > 0 else 0.0
    return mean, min(1e6, max(2.0, 1 / alike - 1)) if alike > 0 else 1e6


def host_verdicts(judged: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``host, n_docs, host_failed`` and a shrunk rate per rule, from rows with ``host`` and a boolean per rule."""
    names = list(failures(rules))
    hosts = judged.where("host is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"failed_{n}").cast("long")).alias(n) for n in names])
    stats = [F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs")]
    for n in names:
        stats += [F.sum(n).alias(f"sum_{n}"), F.sum((F.col(n) - 1) * F.col(n) / F.col("n_docs")).alias(f"pairs_{n}")]
    prior, out = hosts.agg(*stats).first(), hosts  # the prior is one row: a few numbers per rule
    failed = F.lit(False)
    for n in names:
        mean, strength = _beta_binomial(prior["hosts"], prior["docs"] or 0, prior[f"sum_{n}"] or 0, prior[f"pairs_{n}"] or 0.0)
        out = out.withColumn(f"rate_{n}", (F.col(n) + mean * strength) / (F.col("n_docs") + strength))
        by_odds = rules.times_mean * mean / (1 - mean + rules.times_mean * mean)
        failed = failed | (F.col(f"rate_{n}") > min(rules.greatest_limit, max(rules.least_rate, by_odds)))
    return out.withColumn("host_failed", failed).select("host", "n_docs", *[f"rate_{n}" for n in names], "host_failed")


def judge(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """Counts, the base verdict and the final verdict of every document."""
    checks = failures(rules)
    # Written once: texts are read and counted a single time for documents, hosts and the prior.
    judged = cut_lineage(_counts(docs, host).select("*", *[c.alias(f"failed_{n}") for n, c in checks.items()]))
    # Written, so that the join begins with plain exchanges, which Spark can split at a host with very many documents.
    verdicts = cut_lineage(host_verdicts(judged, rules).select("host", "host_failed"))
    base = F.col("failed_short") | F.col("failed_repeats")
    return judged.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~F.coalesce("host_failed", F.lit(False))).alias("kept"), "host",
        F.coalesce("host_failed", F.lit(False)).alias("host_failed"))
