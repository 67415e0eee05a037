"""Shards as the leaves of a k-d tree over metadata, with DataFrame functions only.

The points of the tree are groups of equal texts; a point weighs the bytes of its rows. A group whose bytes exceed the slack is cut into
pieces by a hash of its rows, so a text that fills a third of all rows is many points. A node is split along the dimension in
which its points spread widest (as a share of that dimension's whole range) at a weighted quantile: the median where
its number of leaves is even, else the cut that leaves every leaf the same bytes. Splitting ends with leaves of the target bytes.

Medians are distributed: bytes are summed by node and bin of the dimension's range (merged in each task), the bin that holds the cut is
found from these sums and cut into bins again, until what is undecided weighs no more than the slack; points of equal place
go by the hash of their text. Rows are never sorted or shuffled for a split, and the driver sees one row per node and step.

Law ``bytes``: every cut is off by at most ``slack`` of a leaf's target plus one point, which its leaves share.

Defined cases: a null text has no bytes and is a text of its own kind; null metadata count as least; very long texts are weighed, never
copied; ties of places go by hash, ties of dimensions to the first; repeated rows are rows of their own; null ids come first in their shard;
an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfit.scale import cut_lineage, ordered_rank

#: Bytes that a row counts for besides its text.
ROW_BYTES = 16
#: Places and hashes keep within these, so that differences of them are numbers too.
LEAST, MOST = -(1 << 61), 1 << 61


@dataclass(frozen=True)
class Settings:
    """Number of shards, or their target bytes; bins of a split's step; share of a leaf's bytes that a cut may be off."""

    shards: int | None = 40
    target_bytes: int | None = None
    bins: int = 512
    slack: float = 0.01


def default_dimensions() -> dict[str, Column]:
    """Metadata of ``documents``: source and language in the order of their names, and the length (in steps of about 4 %)."""
    def name(column: str) -> Column:
        # The first seven bytes as a number keep the order of names.
        return F.conv(F.rpad(F.substring(F.hex(F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long")

    return {"source": name("source"), "lang": name("lang"),
            "length": F.floor(F.log(F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1.0)) * 25).cast("long")}


def _frame(spark, rows: Sequence[tuple], kind: str) -> DataFrame:
    """A small frame of literals."""
    names = [part.split() for part in kind.split(", ")]
    structs = [F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, names))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def described(docs: DataFrame, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """``row, doc_id, size, text_crc32, text_hash`` and the places ``d0, d1, ...`` of all rows, without texts. Written down."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = dimensions or default_dimensions()
    places = [F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce(c.cast("long"), F.lit(LEAST)))).alias(f"d{k}") for k, c in enumerate(own.values())]
    return cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.sha2(text, 256))).otherwise(F.lit(b"")).alias("text_hash"), *places))


def _points(rows: DataFrame, n_places: int, slack_bytes: float) -> tuple[DataFrame, DataFrame]:
    """Rows with the piece of their group, and the points: one row per group and piece."""
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"), *(F.min(f"d{k}").alias(f"d{k}") for k in range(n_places)))
    pieces = F.ceil(F.col("bytes") / F.lit(slack_bytes)).cast("long")
    # Fewer groups than shards / slack can be heavier than the slack.
    heavy = F.broadcast(groups.where(F.col("bytes") > slack_bytes).select("text_hash", pieces.alias("pieces")))
    cut = rows.select("row", "doc_id", "size", "text_crc32", "text_hash").join(heavy, "text_hash", "left").withColumn(
        "piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("pieces"))).cast("long")).drop("pieces")
    weights = cut.groupBy("text_hash", "piece").agg(F.sum("size").alias("bytes"))
    return cut, weights.join(groups.drop("bytes"), "text_hash").withColumn("hash", F.shiftright(F.xxhash64("text_hash", "piece"), 3))


@dataclass
class _Split:
    """The search for one node's cut: undecided points lie from ``low`` to ``high``, and ``goal`` bytes of them belong to the left."""

    node: int
    left: int
    dimension: int
    low: int
    high: int
    goal: float
    #: Place of the undecided points once they all have the same: from then on their hashes are searched.
    place: int | None = None
    done: tuple[int, int] | None = None

    def narrow(self, bin_: tuple, slack_bytes: float) -> None:
        before, weight, low, high = bin_
        whole_left = self.goal - before >= weight / 2
        if weight <= slack_bytes or (low == high and self.place is not None):
            bound = high if whole_left else low - 1
            self.done = (bound, MOST) if self.place is None else (self.place, bound)
        elif low == high:
            self.place, self.low, self.high = low, LEAST, MOST
            self.goal -= before
        else:
            self.low, self.high = low, high
            self.goal -= before


def _search(points: DataFrame, splits: list[_Split], n_places: int, bins: int, slack_bytes: float) -> None:
    """Cuts of all nodes of a level. Each step sums the undecided bytes by node and bin."""
    spark, kind = points.sparkSession, "node int, dimension int, place long, low long, high long, goal double"
    while open_ := [s for s in splits if s.done is None]:
        state = F.broadcast(_frame(spark, [(s.node, s.dimension, s.place, s.low, s.high, s.goal) for s in open_], kind))
        own = F.element_at(F.array(*(f"d{k}" for k in range(n_places))), F.col("dimension") + 1)
        rows = points.join(state, "node").withColumn("own", own).where("place is null or own = place").withColumn(
            "key", F.when(F.col("place").isNull(), F.col("own")).otherwise(F.col("hash"))).where("key between low and high")
        step = F.greatest(F.lit(1.0), (F.col("high") - F.col("low") + F.lit(1.0)) / bins)
        binned = rows.groupBy("node", F.least(F.lit(bins - 1), F.floor((F.col("key") - F.col("low")) / step)).alias("bin")).agg(
            F.sum("bytes").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high"), F.first("goal").alias("goal"))
        running = binned.withColumn("upto", F.expr("sum(weight) over (partition by node order by bin)"))
        # The first bin that reaches the goal; sums of doubles aside, the last one always does.
        chosen = running.groupBy("node").agg(
            F.coalesce(
                F.min_by(F.when(F.col("upto") >= F.col("goal"), F.struct("upto", "weight", "low", "high")),
                         F.when(F.col("upto") >= F.col("goal"), F.col("bin"))),
                F.max_by(F.struct("upto", "weight", "low", "high"), "bin")).alias("b"))
        found = {r.node: (r.b.upto - r.b.weight, r.b.weight, r.b.low, r.b.high) for r in chosen.collect()}
        for s in open_:
            s.narrow(found[s.node], slack_bytes)


def _leaves(points: DataFrame, leaves: int, n_places: int, settings: Settings, slack_bytes: float) -> DataFrame:
    """Points with ``node``, the number of their leaf."""
    points = points.withColumn("node", F.lit(0))
    sizes, whole = {0: leaves}, None
    while any(n > 1 for n in sizes.values()):
        points = cut_lineage(points)
        spans = [F.struct(F.min(f"d{k}").alias("low"), F.max(f"d{k}").alias("high")).alias(f"d{k}") for k in range(n_places)]
        told = points.groupBy("node").agg(F.sum("bytes").alias("bytes"), *spans).collect()
        whole = whole or [max(1, told[0][f"d{k}"].high - told[0][f"d{k}"].low) for k in range(n_places)] if told else [1] * n_places
        splits = []
        for r in told:
            if sizes[r.node] > 1:
                spread = [(r[f"d{k}"].high - r[f"d{k}"].low) / whole[k] for k in range(n_places)]
                widest = spread.index(max(spread))
                left = sizes[r.node] // 2
                splits.append(_Split(r.node, left, widest, r[f"d{widest}"].low, r[f"d{widest}"].high, r.bytes * left / sizes[r.node]))
        _search(points, splits, n_places, settings.bins, slack_bytes)
        sizes = {k: m for n, size in sizes.items() for k, m in ([(n, size // 2), (n + size // 2, size - size // 2)] if size > 1 else [(n, size)])}
        if splits:
            cuts = F.broadcast(_frame(points.sparkSession, [(s.node, s.left, s.dimension, *s.done) for s in splits],
                                      "node int, left int, dimension int, place long, upto long"))
            own = F.element_at(F.array(*(f"d{k}" for k in range(n_places))), F.col("dimension") + 1)
            right = (own > F.col("place")) | ((own == F.col("place")) & (F.col("hash") > F.col("upto")))
            points = points.join(cuts, "node", "left").withColumn(
                "node", F.when(F.col("left").isNotNull() & right, F.col("node") + F.col("left")).otherwise(F.col("node"))).drop(
                "left", "dimension", "place", "upto")
    return points


def shards(docs: DataFrame, dimensions: dict[str, Column] | None = None, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of all rows; ``slot`` follows the ids within a shard."""
    n_places = len(dimensions or default_dimensions())
    rows = described(docs, dimensions)
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = settings.shards or max(1, -(-total // settings.target_bytes))
    slack_bytes = max(1.0, settings.slack * total / leaves)
    cut, points = _points(rows, n_places, slack_bytes)
    leaf = _leaves(points, leaves, n_places, settings, slack_bytes).select("text_hash", "piece", F.col("node").alias("shard"))
    placed = cut.join(leaf, ["text_hash", "piece"]).select("row", "doc_id", "size", "text_crc32", "shard")
    ranked = ordered_rank(placed, [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("row")])
    # One row per shard.
    starts = F.broadcast(ranked.groupBy("shard").agg(F.min("rank").alias("start")))
    return ranked.join(starts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
