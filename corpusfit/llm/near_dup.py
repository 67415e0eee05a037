"""Near-duplicates by word shingles: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Every document becomes a set of word shingles and a MinHash signature. Documents with equal sets form one
   class, of which only the least id takes part in what follows.
2. Classes that agree in all values of a band share a bucket. In each bucket all members are first compared
   with its least member only: as many pairs as members.
3. The links found give components. A bucket whose members are all in one component is done. In every other
   one, the members outside its main component are compared with all members of other components, which leaves no
   pair of different components out. Where that would be many pairs, the bucket is laid out in
   blocks of bounded size and pairs of blocks are compared at once, so that no pair becomes a row.
4. A pair is compared signature batch by batch; it is dropped once the posterior chance that its similarity reaches the
   threshold falls below ``miss``. Survivors are confirmed on their full sets in whole numbers.

What can be lost is bounded by two stated chances: that a pair shares no band (``(1 - t^rows)^bands``) and ``miss``.

Defined cases: a document without words (or with null text) has an empty set and no links; a row without a document
id takes part in nothing and is kept; rows that repeat an id count as one document; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfit.llm import shingles
from corpusfit.llm.components import components
from corpusfit.scale import cut_lineage


@dataclass(frozen=True)
class Rule:
    """``words`` per shingle; a link needs ``100 * common >= percent * union``."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 16
    miss: float = 1e-6
    #: Pairs that a bucket may give as rows in the second comparison; beyond it, it is compared in blocks.
    pairs_as_rows: int = 1024
    #: Most members and most shingles of a block.
    block_members: int = 128
    block_shingles: int = 200_000
    #: 64-bit words of the bitmap that tells which texts to read again.
    filter_words: int = 1 << 18

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


@functools.cache
def least_matches(rule: Rule) -> tuple[tuple[int, int], ...]:
    """For every number of values compared, the matches needed to go on.

    With ``m`` of ``n`` values equal and a flat prior, the similarity has a Beta(m + 1, n - m + 1) posterior; a pair goes on
    while its upper tail from the threshold is at least ``miss``.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    upper = grid >= rule.percent / 100
    out = []
    for n in range(rule.batch, rule.hashes + 1, rule.batch):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[upper].sum() >= rule.miss * weight.sum():
                out.append((n, m))
                break
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray, rule: Rule) -> np.ndarray:
    """Rows of two signature tables whose pair is not pruned; later batches are read for the others only."""
    alive, matches, before = np.arange(len(left)), np.zeros(len(left), int), 0
    for n, needed in least_matches(rule):
        matches[alive] += (left[alive, before:n] == right[alive, before:n]).sum(axis=1)
        alive = alive[matches[alive] >= needed]
        before = n
    return alive


def sketch(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, marks = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles.shingle_set(text, rule.words)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                marks.append(shingles.signature(own, rule.hashes).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, signature binary")


def _band_keys(classes: DataFrame, rule: Rule) -> DataFrame:
    """``key, id``: one row per class and band."""
    width = 2 * rule.rows
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(rule.bands - 1)),
        lambda k: F.xxhash64(k, F.col("signature").substr(k * width + 1, F.lit(width))))
    return classes.select(F.explode(keys).alias("key"), "id")


def _pruned(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs ``a, b`` that the posterior bound leaves."""
    marks = classes.select("id", "signature")
    joined = (
        pairs.join(marks.select(F.col("id").alias("b"), F.col("signature").alias("right")), "b")
        .join(marks.select(F.col("id").alias("a"), F.col("signature").alias("left")), "a")
        .select("a", "b", "left", "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, rule.hashes) for k in (2, 3))
            yield batch.select(["a", "b"]).take(pa.array(surviving(left, right, rule), pa.int64()))

    return joined.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """``id, shingles`` (packed 64-bit hashes) of the documents named in ``ids``, and of few others.

    Texts stay where they are: a bitmap over hashed ids, of a fixed number of words whatever the input, goes to all
    tasks. A document that passes by chance is only worked out in vain; joins by id drop it.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(64 * rule.filter_words))
    word, bit = F.shiftright(place, 6), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64L) as int))")
    bitmap = ids.where("id is not null").groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles.shingle_set(text, rule.words).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    near = texts.withColumn("word", word).join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return near.select("id", "text").mapInArrow(run, "id long, shingles binary")


def _linked(common: int, first: int, second: int, rule: Rule) -> bool:
    return 100 * common >= rule.percent * (first + second - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    joined = (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
        .select("a", "b", "left", "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (left, right) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                if 100 * min(len(x), len(y)) >= rule.percent * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if _linked(common, len(x), len(y), rule):
                        keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    left = _pruned(pairs, classes, rule).persist(StorageLevel.DISK_ONLY)
    ids = left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct()
    sets = _sets(docs, ids, rule).persist(StorageLevel.DISK_ONLY)
    links = cut_lineage(_confirmed(left, sets, rule))
    for kept in (left, sets):
        kept.unpersist()
    return links


def _block_links(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Links between components inside crowded buckets.

    ``members`` holds ``key, id, component, outside``. Blocks have bounded numbers of members and of shingles; each
    block with outside members meets every block of its bucket once. Of the links of two blocks, those that join components
    are given: the others say nothing new.
    """
    sets = _sets(docs, members.select("id").distinct(), rule).persist(StorageLevel.DISK_ONLY)
    sized = members.join(sets, "id").withColumn("size", F.length("shingles") / 8)
    # Blocks by hash: about as full as wanted on average, without an order over the bucket.
    load = sized.groupBy("key", "outside").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    load = load.select(
        "key", "outside",
        F.ceil(F.greatest(F.col("n") / rule.block_members, F.col("total") / rule.block_shingles)).cast("int").alias("blocks"))
    placed = sized.join(load, ["key", "outside"]).withColumn(
        "block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    rows = placed.groupBy("key", "outside", "block").agg(
        F.collect_list(F.struct("id", "component", "shingles")).alias("own"))
    rows = rows.persist(StorageLevel.DISK_ONLY)
    first = rows.where("outside").select("key", F.col("block").alias("i"), F.col("own").alias("left"))
    second = rows.select("key", F.col("outside").alias("also"), F.col("block").alias("j"), F.col("own").alias("right"))
    met = first.join(second, "key").where("not also or i <= j").select("left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k in range(batch.num_rows):
                found += _links_between(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), rule)
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = cut_lineage(met.mapInArrow(run, "a long, b long"))
    for kept in (sets, rows):
        kept.unpersist()
    return links


def _links_between(left: list[dict], right: list[dict], rule: Rule) -> list[tuple[int, int]]:
    """Links of two blocks that join different components (a spanning forest of them)."""
    x = [np.frombuffer(m["shingles"], np.uint64) for m in left]
    y = [np.frombuffer(m["shingles"], np.uint64) for m in right]
    every, place = np.unique(np.concatenate(x + y), return_inverse=True)
    ends = np.cumsum([len(v) for v in x + y])
    common = np.zeros((len(x), len(y)), np.float32)
    owner = np.repeat(np.arange(len(x) + len(y)), [len(v) for v in x + y])
    for at in range(0, len(every), 8192):  # membership tables of a bounded width
        part = (place >= at) & (place < at + 8192)
        table = np.zeros((len(x) + len(y), 8192), np.float32)
        table[owner[part], place[part] - at] = 1
        common += table[:len(x)] @ table[len(x):].T
    sizes = np.diff(ends, prepend=0)
    n, m = sizes[:len(x), None], sizes[None, len(x):]
    whole = np.rint(common).astype(np.int64)
    hits = 100 * whole >= rule.percent * (n + m - whole)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(hits)):
        r, s = root(left[i]["component"]), root(right[j]["component"])
        if r != s:
            parent[max(r, s)] = min(r, s)
            out.append((left[i]["id"], right[j]["id"]))
    return out


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    drawn = cut_lineage(sketch(docs, rule))
    named = drawn.where("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(
        named.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min_by("signature", "doc_id").alias("signature")))
    bands = _band_keys(classes, rule)
    buckets = bands.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(bands.join(buckets, "key"))
    stars = shared.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(docs, stars, classes, rule)
    joined = components(links)
    more = _rest(docs, shared, joined, classes, rule)
    joined = components(more.union(joined.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    by_class = classes.join(joined, classes["id"] == joined["node"], "left").select(
        "set_key", F.coalesce("component", "id").alias("component_id"))
    return (
        drawn.drop("signature").join(by_class, "set_key", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _rest(docs: DataFrame, shared: DataFrame, joined: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Links across the components that comparing with each bucket's least member left apart."""
    members = shared.where("n > 2").join(joined, shared["id"] == joined["node"], "left").select(
        "key", "id", "first", "n", F.coalesce("component", "id").alias("component"))
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    open_buckets = parts.groupBy("key").agg(
        F.max_by("component", F.struct("size", "component")).alias("main"),
        F.max("size").alias("main_size"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    members = (
        members.join(open_buckets, "key")
        .withColumn("outside", F.col("component") != F.col("main"))
        .withColumn("crowded", (F.col("n") - F.col("main_size")) * F.col("n") > rule.pairs_as_rows)
        .select("key", "id", "first", "component", "outside", "crowded").persist(StorageLevel.DISK_ONLY))
    few = members.where("not crowded")
    outside = few.where("outside and id <> first").select("key", F.col("id").alias("x"), F.col("component").alias("own"))
    pairs = (
        outside.join(few.where("id <> first").select("key", "id", "component"), "key").where("component <> own")
        .select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct())
    crowded = members.where("crowded").select("key", "id", "component", "outside")
    links = _verified(docs, pairs, classes, rule).union(_block_links(docs, crowded, rule))
    members.unpersist()
    return links


def keep_first(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents, with all their columns, that are the first of their group.

    The ids to drop are joined to the documents. Rows that repeat an id with a text of the same class are one document
    and stay together.
    """
    gone = near_duplicates(docs, rule).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
