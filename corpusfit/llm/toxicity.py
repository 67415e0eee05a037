"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order; the model of each one has the text features and the probabilities of all
earlier categories. In training those probabilities are out-of-fold predictions: a document's value comes from a
model that never saw its fold, and equal texts share a fold. Each category also gets the threshold that did best
out of fold, and all of this is kept in a small model object that is sent to the tasks.

Features are counts of words and word beginnings (``log1p``), chosen by how much their presence tells about any category.
The choice is made in Spark over the training rows; at most ``max_training_rows`` labelled rows (a fixed choice by hash)
and ``features`` columns reach the driver. Everything else, scoring in particular, covers all rows.

Defined cases: a null or empty text has no features and is scored from the intercepts; labels that are null in any category, or
without a document, are not used; repeated labels count once each; when a category has no example of one kind its
probability is that constant rate; empty documents give no rows; further columns are ignored (and returned by ``keep_clean``).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.llm.word_arrays import WordMemo, expand, in_parts
from corpusfit.scale import cut_lineage

ROWS_AT_ONCE = 2_000
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    max_training_rows: int = 10_000
    features: int = 400
    least_documents: int = 3
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    folds: int = 5
    ridge: float = 1.0
    steps: int = 25


@dataclass(frozen=True)
class Chain:
    """Features by name, and one linear model with threshold per category in order."""

    categories: tuple[str, ...]
    features: dict[str, int]
    weights: tuple[np.ndarray, ...]  # intercept, features, earlier categories
    thresholds: tuple[float, ...]
    settings: Settings
    #: Out of fold: (accuracy, precision, recall) by category.
    held_out: tuple[tuple[float, float, float], ...] = ()

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """One row per document and one column per category."""
        inputs = np.hstack([np.ones((len(counts), 1)), np.log1p(counts)])
        for weight in self.weights:
            inputs = np.hstack([inputs, _sigmoid(inputs @ weight)[:, None]])
        return inputs[:, 1 + counts.shape[1]:]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features_of(word: str, prefixes: Sequence[int]) -> list[str]:
    """A word and its beginnings; ``^`` marks a beginning."""
    out = []
    for run in LETTERS.findall(word.lower()):
        out.append(run)
        out += ["^" + run[:k] for k in prefixes if len(run) > k]
    return out


class FeatureIds(WordMemo):
    def __init__(self, features: dict[str, int], prefixes: Sequence[int]):
        super().__init__()
        self.features, self.prefixes = features, prefixes

    def made(self, word: bytes) -> bytes:
        own = [self.features[f] for f in features_of(word.decode(), self.prefixes) if f in self.features]
        return np.array(own, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def _memo(names: tuple[str, ...], prefixes: tuple[int, ...]) -> FeatureIds:
    return FeatureIds({name: k for k, name in enumerate(names)}, prefixes)


def counts(texts: pa.Array, names: tuple[str, ...], prefixes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Feature counts, a table for every bounded part of the texts."""
    memo = _memo(names, prefixes)
    for part in in_parts(texts):
        values, edges = expand(part, memo)
        owner = np.repeat(np.arange(len(part)), np.diff(edges))
        yield np.bincount(owner * len(names) + values, minlength=len(part) * len(names)).reshape(len(part), len(names))


def fit_logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Ridge logistic regression over some rows by Newton steps, read in pieces.

    The first column of ``x`` is the intercept, which is not shrunk.
    """
    w = np.zeros(x.shape[1])
    rate = (y[rows].sum() + 0.5) / (len(rows) + 1)
    w[0] = np.log(rate / (1 - rate))
    if len(np.unique(y[rows])) < 2:
        return w
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-9
    for _ in range(steps):
        gradient, curvature = shrink * w, np.diag(shrink)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            piece = x[rows[at:at + ROWS_AT_ONCE]]
            p = _sigmoid(piece @ w)
            gradient += piece.T @ (p - y[rows[at:at + ROWS_AT_ONCE]])
            curvature += (piece * (p * (1 - p))[:, None].astype(np.float32)).T @ piece
        move = np.linalg.solve(curvature, gradient)
        w -= move
        if np.abs(move).max() < 1e-4:
            break
    return w


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the greatest F1 score; one half when there is nothing to find."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # a cut does not separate equal probabilities
    at = int(np.argmax(f1))
    below = p[order][at + 1] if at + 1 < len(y) else 0.0
    return float((p[order][at] + below) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], settings: Settings) -> DataFrame:
    """``text`` and one 0/1 column per category of the chosen labelled rows."""
    names = list(categories)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(n) for n, c in categories.items()])
    marked = marked.where(F.col("doc_id").isNotNull()).dropna(subset=names)
    chosen = marked.orderBy(F.xxhash64("doc_id", F.lit("training")), "doc_id", *names).limit(settings.max_training_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *names)


def _chosen_features(rows: DataFrame, names: list[str], settings: Settings) -> tuple[str, ...]:
    """Features whose presence has the largest chi-square statistic with some category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = set((batch.column("text")[k].as_py() or "").split())
                own = sorted({f for w in words for f in features_of(w, settings.prefixes)})
                values = [batch.column(n)[k].as_py() for n in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.string()), *[pa.array([v] * len(own), pa.int32()) for v in values]],
                    names=["feature", *names])

    every = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    if not every.n:
        return ()
    schema = "feature string, " + ", ".join(f"{n} int" for n in names)
    found = rows.mapInArrow(run, schema).groupBy("feature").agg(
        F.count(F.lit(1)).alias("present"), *[F.sum(n).alias(n) for n in names])
    strength = F.lit(0.0)
    for n in names:
        rate = (every[n] or 0) / every.n
        if 0 < rate < 1:
            expected = F.col("present") * rate
            gain = (F.col(n) - expected) * (F.col(n) - expected) / (
                expected * (1 - rate) * F.greatest(F.lit(1.0) - F.col("present") / every.n, F.lit(1e-3)))
            strength = F.greatest(strength, gain)
    best = found.where(F.col("present") >= settings.least_documents).orderBy(strength.desc(), "feature").limit(settings.features)
    return tuple(sorted(r.feature for r in best.select("feature").collect()))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], settings: Settings = Settings()) -> Chain:
    """A chain over ``categories`` (name -> 0/1 expression over ``labels``), in their order."""
    names = list(categories)
    rows = cut_lineage(training_rows(docs, labels, categories, settings))
    chosen = _chosen_features(rows, names, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            tables = [t for t in counts(text, chosen, settings.prefixes)] if chosen else [np.zeros((batch.num_rows, 0), int)]
            table = np.minimum(np.vstack(tables), 65_535).astype("<u2")
            rest = [batch.column(n) for n in ("doc_id", "key", *names)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array([r.tobytes() for r in table], pa.binary())], names=["doc_id", "key", *names, "counts"])

    keyed = rows.withColumn("key", F.xxhash64("text"))
    schema = "doc_id long, key long, " + ", ".join(f"{n} int" for n in names) + ", counts binary"
    local = sorted(keyed.mapInArrow(run, schema).collect())
    width = 1 + len(chosen)
    inputs = np.ones((len(local), width + len(names)), np.float32)  # the last columns are for earlier categories
    for k, r in enumerate(local):
        inputs[k, 1:width] = np.log1p(np.frombuffer(r.counts, "<u2"))
    fold = np.array([r.key for r in local], np.int64) % settings.folds
    weights, thresholds, held_out = [], [], []
    for place, name in enumerate(names):
        y = np.array([r[name] for r in local], float)
        known, every = inputs[:, :width + place], np.arange(len(y))
        weights.append(fit_logistic(known, y, every, settings.ridge, settings.steps))
        apart = np.zeros(len(y))
        for k in range(settings.folds):
            rest, own = every[fold != k], every[fold == k]
            if len(own):
                part = fit_logistic(known, y, rest, settings.ridge, settings.steps) if len(rest) else weights[-1]
                apart[own] = _sigmoid(known[own] @ part)
        cut = _best_threshold(apart, y)
        thresholds.append(cut)
        said = apart >= cut
        hits = float((said & (y > 0)).sum())
        held_out.append((
            float((said == (y > 0)).mean()) if len(y) else 0.0, hits / max(1, said.sum()), hits / max(1.0, y.sum())))
        inputs[:, width + place] = apart
    return Chain(
        tuple(names), {f: k for k, f in enumerate(chosen)}, tuple(weights), tuple(thresholds), settings, tuple(held_out))


def _scores(texts: pa.Array, chain: Chain) -> np.ndarray:
    names = tuple(chain.features)
    tables = counts(texts, names, chain.settings.prefixes) if names else [np.zeros((len(texts), 0))]
    parts = [chain.probabilities(table) for table in tables]
    return np.vstack(parts) if parts else np.zeros((0, len(chain.categories)))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability per category (``p_<name>``) and a decision per category (``<name>``) of every row."""
    names = chain.categories
    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", " + ", ".join(f"{n} boolean" for n in names)
    columns = ["doc_id", *[f"p_{n}" for n in names], *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(batch.column(1), chain)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p[:, k]) for k in range(len(names))],
                 *[pa.array(p[:, k] >= cut) for k, cut in enumerate(chain.thresholds)]], names=columns)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return texts.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, chain: Chain, category: str) -> DataFrame:
    """The documents that the chain does not put in ``category``, with all their columns."""
    at = chain.categories.index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(batch.column(batch.schema.get_field_index("text")), chain)
            yield batch.filter(pa.array(p[:, at] < chain.thresholds[at], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def categories_of_labels() -> dict[str, Column]:
    """The categories that the ``labels`` table holds, in chain order."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
