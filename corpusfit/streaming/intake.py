"""Landing of messages: a message is stored once, routed, and may be retried."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfit.scale import cut_lineage
from corpusfit.streaming import run

# States from which a message may be taken in again.
RETRYABLE = ("failed", "keyword_filtered", "new")


def intake_dedup(stream: DataFrame, id_col: str, ts: str, delay: str = "1 day") -> DataFrame:
    """First row of each message id; state is dropped once the watermark has passed it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def land_with_late(stream: DataFrame, folder: str, id_col: str, ts: str, delay_seconds: int) -> None:
    """First row of each message id as ``intake_dedup``, with a side table of the rows that come too late.

    The mark is the newest time of earlier batches less the delay. A row before it goes to ``folder``/late and is counted there. The
    others land once: only ids that landed within two delays of the newest time are read, by day, so a batch costs the
    same however much has landed. A batch that is repeated after a failure replaces its own files. A row without a time
    cannot be late and meets the rows without a time.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = None
        if batch_id > 0:
            newest = spark.read.parquet(f"{folder}/marks").where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        rows = cut_lineage(batch)  # the source is read once for four results
        mark = F.lit(newest) - F.make_dt_interval(secs=F.lit(delay_seconds))
        late = F.coalesce(F.col(ts) < mark, F.lit(False)) if newest is not None else F.lit(False)
        first = run.first_rows(rows.where(~late), [id_col], [ts])
        if batch_id > 0:
            known = run.read_result(spark, folder).where(F.col("batch_id") < batch_id)
            if newest is not None:
                since = F.to_date(F.lit(newest) - F.make_dt_interval(secs=F.lit(2 * delay_seconds)))
                known = known.where(F.col("day").isNull() | (F.col("day") >= since))
            first = first.join(known.select(id_col), id_col, "left_anti")
        first.withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/data/batch_id={batch_id}")
        rows.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
        rows.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{folder}/marks/batch_id={batch_id}")

    run.run_batches(stream, folder, handle)


def late_counts(spark, folder: str) -> DataFrame:
    """Late rows per batch."""
    return spark.read.parquet(f"{folder}/late").groupBy("batch_id").agg(F.count(F.lit(1)).alias("late"))


def intake_merge(landing: DataFrame, incoming: DataFrame, order: str = "received_at") -> DataFrame:
    """Landing table after a batch: new ids are added, retryable rows replaced, others kept."""
    values = [c for c in landing.columns if c != "message_id"]
    first = incoming.groupBy("message_id").agg(
        F.min_by(F.struct(*values), F.struct(order, "status")).alias("__new"))
    both = landing.select("message_id", F.struct(*values).alias("__old")).join(first, "message_id", "full")
    keep = F.col("__old").isNotNull() & (F.col("__new").isNull() | ~F.col("__old.status").isin(*RETRYABLE))
    return both.withColumn("__row", F.when(keep, F.col("__old")).otherwise(F.col("__new"))).select("message_id", "__row.*")


def due_messages(landing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Messages of a batch that still have to be handled, the earliest row of each."""
    done = landing.filter(~F.col("status").isin(*RETRYABLE)).select("message_id")
    order = [c for c in ("received_at",) if c in incoming.columns]
    return run.first_rows(incoming, ["message_id"], order).join(done, "message_id", "left_anti")


def intake_route(batch: DataFrame, attachments: DataFrame, keywords: Sequence[str] = ()) -> DataFrame:
    """State of each message: keyword_filtered, no_attachment, processed (one stored is enough) or failed.

    ``attachments`` has message_id and stored (boolean).
    """
    stored = attachments.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("files"), F.max(F.col("stored").cast("int")).alias("__any"))
    hit = F.lit(True)
    if keywords:
        words = F.array(*[F.lit(k.lower()) for k in keywords])
        hit = F.exists(words, lambda k: F.contains(F.lower(F.coalesce("subject", F.lit(""))), k))
    return batch.join(stored, "message_id", "left").withColumn(
        "status",
        F.when(~hit, "keyword_filtered").when(F.col("files").isNull(), "no_attachment")
        .when(F.col("__any") == 1, "processed").otherwise("failed"),
    ).withColumn(
        "error", F.when(F.col("status") == "failed", "no attachment could be read")
    ).drop("__any")


def landed(spark, folder: str) -> DataFrame:
    """Landing table: the last stored row of each message."""
    log = run.read_result(spark, folder)
    values = [c for c in log.columns if c not in ("message_id", "batch_id")]
    return log.groupBy("message_id").agg(F.max_by(F.struct(*values), "batch_id").alias("__row")).select(
        "message_id", "__row.*")


def land_stream(stream: DataFrame, folder: str) -> None:
    """Append to a landing log only the messages of each batch that are new or may be retried.

    A finished state is never replaced, so the log's ids in such a state are enough to decide;
    only those two columns of earlier batches are read.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        due = run.first_rows(batch, ["message_id"], [c for c in ("received_at",) if c in batch.columns])
        if batch_id > 0:
            log = run.read_result(spark, folder).filter(F.col("batch_id") < batch_id)
            due = due_messages(log.select("message_id", "status"), batch)
        run.write_batch(due, folder, batch_id)

    run.run_batches(stream, folder, handle)
