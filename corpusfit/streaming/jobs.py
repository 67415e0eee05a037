"""Streaming twins of batch reports, and scoring of new documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfit.streaming import run


def daily_stream(stream: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Rows per day as data arrives; a day is final once the watermark has passed it.

    Rows that come later than ``delay`` are not counted; ``store_daily`` counts them too.
    """
    return (
        stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("count")).select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), "count"))


def store_daily(stream: DataFrame, ts: str, folder: str) -> None:
    """Rows per day of every batch, under the batch's id. No watermark, so rows that come late are counted like all others."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        days = batch.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("count"))
        run.write_batch(days, folder, batch_id)

    run.run_batches(stream, folder, handle)


def daily_totals(spark, folder: str) -> DataFrame:
    """Rows per day over all stored batches."""
    return run.read_result(spark, folder).groupBy("date").agg(F.sum("count").alias("count"))


def first_open(stream: DataFrame, token: str, ts: str) -> DataFrame:
    """Earliest event per token so far (update mode)."""
    return stream.groupBy(token).agg(F.min(ts).alias("first_open"))


def store_updates(stream: DataFrame, folder: str) -> None:
    """Write every change of an updating aggregate under its batch id."""
    run.run_batches(stream, folder, lambda batch, batch_id: run.write_batch(batch, folder, batch_id), mode="update")


def latest_updates(spark, folder: str, key: str, value: str) -> DataFrame:
    """Newest value per key of a stored updating aggregate."""
    return run.read_result(spark, folder).groupBy(key).agg(F.max_by(value, "batch_id").alias(value))


def incremental_scoring(batch: DataFrame, evals: DataFrame, score) -> DataFrame:
    """Score the documents of a batch that have no finished evaluation. ``score`` maps pairs to evaluations."""
    done = evals.filter("eval_status is null").select("doc_id", "role_id")
    return score(batch.join(done, ["doc_id", "role_id"], "left_anti"))


def score_stream(stream: DataFrame, folder: str, score) -> None:
    """Score each arriving pair once; results of earlier batches are the finished evaluations."""
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        pairs = run.first_rows(batch, ["doc_id", "role_id"])
        if batch_id == 0:
            done = spark.createDataFrame([], "doc_id long, role_id long, eval_status string")
        else:
            done = run.read_result(spark, folder).filter(F.col("batch_id") < batch_id)
        run.write_batch(incremental_scoring(pairs, done, score), folder, batch_id)

    run.run_batches(stream, folder, handle)
