"""Running streams: file sources, work folders and once-through execution."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusfit.scale import cut_lineage, ensure_checkpoint_dir

POLL_SECONDS = 60


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_trigger: int = 100
) -> DataFrame:
    """Parquet files of a landing folder as they arrive, a bounded number per batch."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def batches_stream(rows: DataFrame, folder: str, upto: Sequence[Column]) -> DataFrame:
    """The rows as a stream with one batch for those that each condition holds for first, and one for the rest.

    Each batch is one file, written one after another: a file source takes files by time of change. The rows are made
    in many tasks first, so the one task of a file only copies them.
    """
    number = F.coalesce(*(F.when(c, k) for k, c in enumerate(upto)), F.lit(len(upto)))
    made = cut_lineage(rows.withColumn("__batch", number))
    for k in range(len(upto) + 1):
        made.where(F.col("__batch") == k).drop("__batch").coalesce(1).write.mode("append").parquet(folder)
    return file_stream(rows.sparkSession, folder, rows.schema, files_per_trigger=1)


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Process everything available, appending result files to ``folder``/data."""
    (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination())


def run_batches(stream: DataFrame, folder: str, handle, mode: str = "append") -> None:
    """Process everything available through ``handle(batch, batch_id)``."""
    (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination())


def write_batch(batch: DataFrame, folder: str, batch_id: int) -> None:
    """Store one batch under its id; repeating a batch after a failure replaces its files."""
    batch.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")


def read_result(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/data")


def start_polling(stream: DataFrame, folder: str, handle, seconds: int = POLL_SECONDS):
    """Long-running form: one batch per poll interval. Returns the running query."""
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/progress")
        .trigger(processingTime=f"{seconds} seconds").start())


def first_rows(batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key, the same one in every attempt: the first by ``order``, then by a hash of the row."""
    values = [c for c in batch.columns if c not in keys]
    place = F.struct(*order, F.xxhash64(*batch.columns))
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*values), place).alias("__row")).select(*keys, "__row.*") if values else (
        batch.select(*keys).distinct())
