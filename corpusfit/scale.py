"""Helpers that keep jobs whole and balanced on a large cluster.

* ``cut_lineage``   table written to the cluster's shared checkpoint folder
* ``spread``        more tasks for an input that arrives as few file splits
* ``by_shuffle``    join side that must not be broadcast on a wrong size estimate
* ``salted_join``   equi-join whose left key may be hot
* ``ordered_rank``  global 1..n ranks without a single-task window
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for a session of one machine.

    A cluster has to name a shared folder: executors would write a local one each to their own disk, and reading
    it back would miss rows without notice.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corpusfit-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and read it back.

    It survives lost executors like a reliable checkpoint, and being columnar it lets later
    steps read only the columns they need and know the real size.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition inputs that are too small to give every core a file split.

    The planner's size estimate decides (nothing is executed); a large table already has
    many splits, so no shuffle is added there.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    split = spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= want * (int(split) if split.isdigit() else 134217728):
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is shuffled and sorted, never broadcast.

    The planner takes the size of packed files as the size of their rows and counts an exploded row as one, so it would
    send tables through the driver that are many times larger than it believes.
    """
    return df.hint("merge")


def salted_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join with ``left`` rows of one key spread over ``salts`` tasks.

    ``right`` must be unique (or nearly so) per key: it is repeated ``salts`` times,
    so it should be the aggregated or dimension side. The copies are not in the planner's
    estimate, so both sides are shuffled.
    """
    keys = [on] if isinstance(on, str) else list(on)
    hashable = [f.name for f in left.schema.fields if f.dataType.typeName() in (
        "long", "integer", "short", "byte", "string", "double", "float", "boolean", "date",
        "timestamp", "timestamp_ntz", "decimal")]
    spread_left = left.withColumn(
        "__salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")
    )
    spread_right = right.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return spread_left.join(by_shuffle(spread_right), [*keys, "__salt"], how).drop("__salt")


def ordered_rank(
    df: DataFrame, order: Sequence[Column], rank_col: str = "rank"
) -> DataFrame:
    """Number all rows 1..n in ``order`` (which must end in a unique key).

    Range-partition, sort inside each partition, fix the layout by writing it
    down, then add each partition's offset. Only one row per partition is
    ever brought together.
    """
    laid_out = cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn(
            "__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    sizes = laid_out.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        "__pid",
        F.expr("sum(__n) over (order by __pid) - __n").alias("__before"),
    )
    return (
        laid_out.join(F.broadcast(offsets), "__pid")
        .withColumn(rank_col, (F.col("__before") + F.col("__pos") + 1).cast("long"))
        .drop("__pid", "__pos", "__before")
    )
