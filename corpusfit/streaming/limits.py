"""Request rates per client and route, and intake targets per role, over batches of a stream.

Both keep their state as tables below the run's folder, one version per batch, so a repeated batch starts from the same state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfit.scale import cut_lineage
from corpusfit.streaming import run

# Fixed values: (route prefix, window seconds, requests) and the default.
ROUTE_LIMITS = (("/auth/login", 60, 10), ("/auth/register", 60, 5), ("/upload", 60, 30))
DEFAULT_LIMIT = (60, 300)

DECISION = "client string, route string, event_id long, us long, allowed boolean, retry_after long"
STAMP = "client string, route string, us long, seconds int, max_n int"
MICROS = 1_000_000


def route_limits(path, limits=ROUTE_LIMITS, default=DEFAULT_LIMIT):
    """Struct(route, seconds, max_n) of a request path; the first matching prefix counts."""
    out = F.struct(F.lit("__default__").alias("route"), F.lit(default[0]).alias("seconds"), F.lit(default[1]).alias("max_n"))
    for prefix, seconds, max_n in reversed(limits):
        rule = F.struct(F.lit(prefix).alias("route"), F.lit(seconds).alias("seconds"), F.lit(max_n).alias("max_n"))
        out = F.when(path.startswith(prefix), rule).otherwise(out)
    return out


def client_of(forwarded: Column, peer: Column) -> Column:
    """The first forwarded address, else the peer's, else ``unknown``."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(F.coalesce(peer, F.lit("unknown")))


def requests_of(stream: DataFrame, path: Column | None = None, limits=ROUTE_LIMITS, default=DEFAULT_LIMIT) -> DataFrame:
    """``client, route, event_id, us, seconds, max_n`` of requests (client, event_id, ts) and their paths."""
    rule = route_limits(path if path is not None else F.lit(""), limits, default)
    return stream.select(
        F.col("client").cast("string").alias("client"), F.col("event_id").cast("long").alias("event_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), rule.alias("rule")).select(
        "client", "rule.route", "event_id", "us", F.col("rule.seconds").cast("int").alias("seconds"), F.col("rule.max_n").cast("int").alias("max_n"))


class SlidingLog:
    """Accepted stamps of one client and route within its window; never more than the limit."""

    def __init__(self, stamps=()):
        self.stamps = deque(stamps)

    def admit(self, us: int, window: int, most: int) -> int | None:
        """None if the request passes (it is logged then), else the seconds until one would."""
        while self.stamps and self.stamps[0] < us - window:
            self.stamps.popleft()
        if len(self.stamps) < most:
            self.stamps.append(us)
            return None
        # With a limit of none there is nothing to wait for but the window itself.
        return (window - (us - self.stamps[0])) // MICROS + 1 if self.stamps else window // MICROS + 1


def _in_sequence(batches: Iterator[Any]) -> Iterator[Any]:
    """Decide the requests of crowded pieces, which come sorted; only the log of the piece at hand is kept."""
    import pandas as pd

    now, log = None, SlidingLog()
    for rows in batches:
        out = []
        for client, route, piece, us, event_id, seconds, max_n, carried in rows.itertuples(index=False):
            if (client, route, piece) != now:
                now, log = (client, route, piece), SlidingLog()
            if carried:
                log.stamps.append(us)
                continue
            wait = log.admit(us, seconds * MICROS, max_n)
            out.append((client, route, event_id, us, wait is None, wait))
        frame = pd.DataFrame(out, columns=["client", "route", "event_id", "us", "allowed", "retry_after"])
        yield frame.astype({"event_id": "int64", "us": "int64", "allowed": "bool", "retry_after": "Int64"})


def pieces_of(requests: DataFrame, carried: DataFrame) -> DataFrame:
    """All rows with ``piece`` and ``crowded``: logs cut at gaps longer than the window, and whether a piece may pass its limit.

    A gap lies between occupied slots of one window's length, so it is found from one row per client, route and slot; a client with
    very many requests in a slot is one such row. Pieces whose neighbouring slots stay within the limit are told at once, the others by
    the exact count of requests in the window of each stamp (per slot, so a long piece is many tasks).
    """
    key = ["client", "route"]
    rows = requests.select(*key, "us", "event_id", "seconds", "max_n", F.lit(False).alias("carried")).unionByName(
        carried.select(*key, "us", F.lit(None).cast("long").alias("event_id"), "seconds", "max_n", F.lit(True).alias("carried")))
    span = F.col("seconds").cast("long") * MICROS
    rows = rows.withColumn("slot", F.floor(F.col("us") / span))
    slots = rows.groupBy(*key, "slot").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first"), F.max("us").alias("last"),
        F.max("seconds").alias("seconds"), F.max("max_n").alias("max_n"))
    order = Window.partitionBy(*key).orderBy("slot")
    starts = F.coalesce(F.col("first") - F.lag("last").over(order) > span, F.lit(True))
    near = F.col("n") + F.when(F.lag("slot").over(order) == F.col("slot") - 1, F.lag("n").over(order)).otherwise(0)
    slots = slots.select(*key, "slot", starts.cast("long").alias("starts"), (near > F.col("max_n")).alias("dense")).withColumn(
        "piece", F.sum("starts").over(order)).withColumn("dense", F.max("dense").over(Window.partitionBy(*key, "piece")))
    return rows.join(slots.select(*key, "slot", "piece", "dense"), [*key, "slot"])


def _crowded(dense: DataFrame) -> DataFrame | None:
    """Pieces in which some window holds more requests than the limit, refused ones included; None if there is no dense piece."""
    key = ["client", "route", "piece"]
    stamps = dense.groupBy(*key, "slot", "us").agg(F.count(F.lit(1)).alias("n"), F.max("seconds").alias("seconds"), F.max("max_n").alias("max_n"))
    seen = stamps.withColumn("late", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("home", F.col("slot") + F.col("late"))
    upto = Window.partitionBy(*key, "home").orderBy("us")
    lengths = [r.seconds for r in dense.select("seconds").distinct().collect()]  # a window's length is a literal; one per rule
    over = None
    for seconds in lengths:
        window = upto.rangeBetween(-seconds * MICROS, 0)
        part = seen.where(F.col("seconds") == seconds).withColumn("within", F.sum("n").over(window)).where("late = 0 and within > max_n")
        over = part.select(*key) if over is None else over.unionByName(part.select(*key))
    return over.distinct() if over is not None else None


def decide(requests: DataFrame, carried: DataFrame) -> DataFrame:
    """Decisions on the requests of a batch given accepted stamps of earlier ones (``carried``), by a sliding log per client and route.

    Requests that are refused are not logged, so a decision depends on those before it; but only within a piece, and only in a
    piece where more requests than the limit fall in some window. All other requests pass without Python.
    """
    key = ["client", "route", "piece"]
    told = cut_lineage(pieces_of(requests, carried))
    dense = told.where("dense")
    crowded = _crowded(dense)
    crowded = None if crowded is None else cut_lineage(crowded)
    passed = told.where("not carried") if crowded is None else told.where("not dense and not carried").unionByName(
        dense.where("not carried").join(crowded, key, "left_anti"), allowMissingColumns=True)
    out = passed.select("client", "route", "event_id", "us", F.lit(True).alias("allowed"), F.lit(None).cast("long").alias("retry_after"))
    if crowded is None:
        return out
    rest = dense.join(crowded, key, "left_semi").select(*key, "us", "event_id", "seconds", "max_n", "carried")
    in_order = rest.repartition(*key).sortWithinPartitions(*key, "us", F.desc("carried"), "event_id")
    return out.unionByName(in_order.mapInPandas(_in_sequence, DECISION))


def rate_limit(stream: DataFrame, folder: str) -> None:
    """Decide the requests of a stream (``requests_of``) batch by batch.

    A request that arrives with a stamp before the latest one of earlier batches counts at that time, as it would have on arrival.
    The state of a batch are the accepted stamps within one window of the latest time, whoever's: a client without
    requests is forgotten after one window.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            carried, clock = spark.createDataFrame([], STAMP), None
        else:
            carried = spark.read.schema(STAMP).parquet(f"{folder}/state/batch_id={batch_id - 1}")
            clock = spark.read.parquet(f"{folder}/clock/batch_id={batch_id - 1}").first()[0]
        rows = batch if clock is None else batch.withColumn("us", F.greatest("us", F.lit(clock)))
        run.write_batch(decide(rows, carried), folder, batch_id)
        made = spark.read.parquet(f"{folder}/data/batch_id={batch_id}")
        latest = made.agg(F.max("us").alias("us"))
        now = max((x for x in (clock, latest.first()[0]) if x is not None), default=None)
        spark.range(1).select(F.lit(now).cast("long").alias("us")).write.mode("overwrite").parquet(f"{folder}/clock/batch_id={batch_id}")
        rules = rows.select("client", "route", "event_id", "us", "seconds", "max_n")
        fresh = made.where("allowed").join(rules, ["client", "route", "event_id", "us"]).select("client", "route", "us", "seconds", "max_n")
        alive = carried.unionByName(fresh).where(F.col("us") >= F.lit(now).cast("long") - F.col("seconds").cast("long") * MICROS)
        alive.write.mode("overwrite").parquet(f"{folder}/state/batch_id={batch_id}")

    run.run_batches(stream, folder, handle)


def pause_decisions(batch: DataFrame, so_far: DataFrame, targets: DataFrame) -> DataFrame:
    """accepted/queued for applications (role_id, app_id, ts, score) in order, given the state of each role.

    ``so_far`` has role_id, qualified and paused; ``targets`` role_id, min_fit_score and target. A role that is not paused takes
    applications, the first one in any case, until those that qualify have reached its target; then it is paused. How many qualify before
    an application comes from range partitions with their own running counts and offsets per role: nothing is listed, and
    a role with most of the rows is many tasks. Applications with ``again`` (drained ones) come before the others.
    """
    state = targets.select("role_id", "min_fit_score", "target").join(so_far.select("role_id", "qualified", "paused"), "role_id", "left").select(
        "role_id", "min_fit_score", "target", F.coalesce("qualified", F.lit(0)).alias("so_far"), F.coalesce("paused", F.lit(False)).alias("paused"))
    rows = batch if "again" in batch.columns else batch.withColumn("again", F.lit(False))
    rows = rows.select("role_id", "app_id", "ts", "score", "again").join(state, "role_id").withColumn(
        "qualified", F.coalesce(F.col("score") >= F.col("min_fit_score"), F.lit(False)))
    order = [F.col("role_id"), F.desc("again"), F.col("ts"), F.col("app_id")]
    laid_out = cut_lineage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    parts = laid_out.groupBy("role_id", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if("qualified").alias("good"))
    offsets = parts.select(
        "role_id", "part", F.expr("sum(n) over (partition by role_id order by part) - n").alias("rows_before"),
        F.expr("sum(good) over (partition by role_id order by part) - good").alias("good_before"))
    own = Window.partitionBy("role_id", "part").orderBy("at")
    good = F.col("qualified").cast("long")
    counted = laid_out.withColumn("own_before", F.sum(good).over(own) - good).withColumn("own_place", F.row_number().over(own) - 1)
    before = F.col("so_far") + F.col("good_before") + F.col("own_before")
    first = F.col("rows_before") + F.col("own_place") == 0
    takes = ~F.col("paused") & (first | F.col("target").isNull() | (before < F.col("target")))
    return counted.join(offsets, ["role_id", "part"]).select(
        "role_id", "app_id", "ts", "score", F.when(takes, "accepted").otherwise("queued").alias("decision"), "qualified")


def pause_stream(stream: DataFrame, targets: DataFrame, folder: str, controls: DataFrame | None = None) -> None:
    """Decide a stream of applications.

    ``controls`` (role_id, batch_id, target) resumes roles from a batch on, with a target that replaces the one before (null: none): what is
    queued for the role is then decided again, before the batch's own applications. Each batch stores its decisions, what it has
    queued, and the state after it, and reads the state of the one before, so repeating a batch gives the same answer. Of the
    earlier queues only those since a role's last resumption are read, and only when it is resumed.
    """
    spark = stream.sparkSession
    state_kind = "role_id int, qualified long, paused boolean, target long, since int"

    def handle(batch: DataFrame, batch_id: int) -> None:
        start = targets.select(
            "role_id", F.lit(0).cast("long").alias("qualified"), F.lit(False).alias("paused"), F.col("target").cast("long").alias("target"), F.lit(0).alias("since"))
        state = start if batch_id == 0 else spark.read.schema(state_kind).parquet(f"{folder}/state/batch_id={batch_id - 1}")
        rows = batch.select("role_id", "app_id", "ts", "score", F.lit(False).alias("again"))
        if controls is not None:
            now = controls.where(F.col("batch_id") == batch_id).groupBy("role_id").agg(
                F.max(F.struct(F.col("target").cast("long").alias("target"))).alias("new"))
            state = state.join(now, "role_id", "left")
            if batch_id > 0:
                due = state.where("new is not null").select("role_id", "since")
                queued = spark.read.parquet(f"{folder}/queue").where(F.col("batch_id") < batch_id).join(due, "role_id").where("batch_id >= since")
                rows = rows.unionByName(queued.select("role_id", "app_id", "ts", "score", F.lit(True).alias("again")))
            resumed = F.col("new").isNotNull()
            state = state.select(
                "role_id", "qualified", (F.col("paused") & ~resumed).alias("paused"),
                F.when(resumed, F.col("new.target")).otherwise(F.col("target")).alias("target"),
                F.when(resumed, F.lit(batch_id)).otherwise(F.col("since")).alias("since"))
        state = cut_lineage(state)
        rules = targets.select("role_id", "min_fit_score").join(state.select("role_id", "target"), "role_id")
        run.write_batch(pause_decisions(rows, state, rules), folder, batch_id)
        made = spark.read.parquet(f"{folder}/data/batch_id={batch_id}")
        made.where("decision = 'queued'").select("role_id", "app_id", "ts", "score").write.mode("overwrite").parquet(f"{folder}/queue/batch_id={batch_id}")
        taken = made.where("decision = 'accepted'").groupBy("role_id").agg(F.count_if("qualified").alias("more"))
        total = F.col("qualified") + F.coalesce("more", F.lit(0))
        full = F.col("more").isNotNull() & F.coalesce(total >= F.col("target"), F.lit(False))
        state.join(taken, "role_id", "left").select(
            "role_id", total.cast("long").alias("qualified"), (F.col("paused") | full).alias("paused"), "target", F.col("since").cast("int").alias("since")
        ).write.mode("overwrite").parquet(f"{folder}/state/batch_id={batch_id}")

    run.run_batches(stream, folder, handle)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision on each application of a stored run; drained ones have several."""
    values = [c for c in decisions.columns if c not in ("role_id", "app_id", "batch_id")]
    return decisions.groupBy("role_id", "app_id").agg(F.max_by(F.struct(*values), "batch_id").alias("__d")).select("role_id", "app_id", "__d.*")


def drain_queue(decisions: DataFrame, roles: DataFrame) -> DataFrame:
    """Queued applications of roles that take applications again."""
    return decisions.filter("decision = 'queued'").join(roles.select("role_id").distinct(), "role_id", "left_semi")
