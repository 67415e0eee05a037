"""Connected components of a link table, by alternating star contractions.

Each step gives every node's larger neighbours (then its smaller ones) to the least node among them. Steps are
joins and map-side combined minima, so a node with very many links is no special case; each step's links are
written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfit.scale import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    moved = near.where("b > a").join(least, "a").select(F.col("low").alias("a"), "b")
    return moved.where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.col("b").alias("node"), F.col("a").alias("near"))
    least = down.groupBy("node").agg(F.min("near").alias("low"))
    moved = down.join(least, "node").select(F.col("low").alias("a"), F.col("near").alias("b"))
    return moved.union(least.select(F.col("low").alias("a"), F.col("node").alias("b"))).where("a < b").distinct()


def _state(links: DataFrame) -> tuple:
    found = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(found)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node that has a link; links are (a, b) with any order of ids.

    The component is its least node. Null ends and links of a node with itself are no links.
    """
    links = cut_lineage(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = _state(links)
    while True:
        links = cut_lineage(_small_star(_large_star(links)))
        now = _state(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
