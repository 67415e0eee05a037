"""Streaming queries: the given tables are read as streams and run until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusfit.catalog.registry import query
from corpusfit.streaming import intake, jobs, limits, run

C = F.col


def _stream(v, table: str):
    """A table that is one file, or a folder of files; only a pattern of paths may name either."""
    return run.file_stream(v.spark, f"{v.folder}/{table}.parque[t]", v(table).schema, "*")


def _shuffled_stream(v, table: str, again: str | None = None):
    """The table as four files in no order of time, one file per batch; rows that ``again`` names come twice."""
    rows = v(table)
    if again:
        rows = rows.unionByName(v(table).filter(again))
    folder = run.work_folder(v.spark, f"{table}-files")
    rows.repartition(4, F.hash(*rows.columns), F.rand(7)).write.parquet(folder)
    return run.file_stream(v.spark, folder, rows.schema, files_per_trigger=1)


def _landing(events):
    kind = C("event_type")
    status = (
        F.when(kind == "view", "processed").when(kind == "click", "new").when(kind == "signup", "no_attachment")
        .when(kind == "purchase", "keyword_filtered").otherwise("failed"))
    return events.select(C("event_id").alias("message_id"), C("ts").alias("received_at"), status.alias("status"))


@query("intake_stream", "SELECT event_id, ts, event_type FROM events")
def _(v):
    folder = run.work_folder(v.spark, "intake")
    run.run_once(_stream(v, "events").select("event_id", "ts", "event_type"), folder)
    return run.read_result(v.spark, folder)


@query("intake_dedup", "SELECT message_id, received_at, status FROM landing")
def _(v):
    """The stream holds a third of the messages twice; each lands once."""
    folder = run.work_folder(v.spark, "dedup")
    events = _stream(v, "events")
    doubled = events.unionByName(_stream(v, "events").filter("user_id % 3 = 0"))
    rows = _landing(doubled).withColumn("received_at", C("received_at").cast("timestamp"))
    run.run_once(intake.intake_dedup(rows, "message_id", "received_at", "60 days"), folder)
    return run.read_result(v.spark, folder).withColumn("received_at", C("received_at").cast("timestamp_ntz"))


@query("intake_late", """WITH m AS (SELECT message_id, received_at, CASE WHEN day(received_at) <= 10 THEN 0 WHEN day(received_at) > 20 THEN 1 ELSE 2 END AS b, events.user_id FROM landing JOIN events ON event_id = message_id),
    e AS (SELECT message_id, received_at, b FROM m UNION ALL SELECT message_id, received_at, greatest(b, 1) FROM m WHERE user_id % 3 = 0),
    t AS (SELECT b, max(received_at) AS newest FROM e GROUP BY b),
    l AS (SELECT message_id, b, coalesce(received_at < (SELECT max(newest) FROM t WHERE t.b < e.b) - INTERVAL 15 DAY, false) AS late FROM e),
    f AS (SELECT message_id, min(b) AS b FROM l WHERE NOT late GROUP BY message_id)
  SELECT message_id, 'landed' AS fate, b AS batch_id FROM f UNION ALL SELECT message_id, 'late', b FROM l WHERE late""")
def _(v):
    """First the month's first ten days, then its end, then what lies between; a third of the messages come twice."""
    folder = run.work_folder(v.spark, "late")
    rows = _landing(v("events").withColumn("ts", C("ts").cast("timestamp"))).join(v("events").select(C("event_id").alias("message_id"), "user_id"), "message_id")
    day = F.dayofmonth("received_at")
    part = F.when(day <= 10, 0).when(day > 20, 1).otherwise(2)
    sent = rows.withColumn("part", part).unionByName(rows.where("user_id % 3 = 0").withColumn("part", F.greatest(part, F.lit(1))))
    stream = run.batches_stream(sent, f"{folder}/in", [C("part") == 0, C("part") == 1])
    intake.land_with_late(stream.drop("part", "user_id"), folder, "message_id", "received_at", 15 * 86400)
    landed = run.read_result(v.spark, folder).select("message_id", F.lit("landed").alias("fate"), C("batch_id").cast("int"))
    late = v.spark.read.parquet(f"{folder}/late").select("message_id", F.lit("late").alias("fate"), C("batch_id").cast("int"))
    return landed.unionByName(late)


@query("intake_merge", """SELECT message_id, received_at, CASE WHEN status IN ('failed', 'keyword_filtered', 'new') THEN 'processed' ELSE status END AS status FROM landing""")
def _(v):
    stored = v("landing").select("message_id", "received_at", "status")
    again = stored.withColumn("status", F.lit("processed"))
    return intake.intake_merge(stored, again)


@query("intake_landing_stream", "SELECT message_id, received_at, status FROM landing")
def _(v):
    folder = run.work_folder(v.spark, "landing")
    intake.land_stream(_landing(_shuffled_stream(v, "events", "user_id % 3 = 0")), folder)
    return intake.landed(v.spark, folder)


@query("intake_route", """WITH a AS (SELECT l_orderkey AS message_id, l_quantity > 30 AS stored FROM lineitem),
    g AS (SELECT message_id, count(*) AS files, bool_or(stored) AS ok FROM a GROUP BY message_id)
  SELECT o_orderkey AS message_id, CASE WHEN NOT (contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderpriority), 'low')) THEN 'keyword_filtered'
    WHEN files IS NULL THEN 'no_attachment' WHEN ok THEN 'processed' ELSE 'failed' END AS status FROM orders LEFT JOIN g ON message_id = o_orderkey""")
def _(v):
    batch = v("orders").select(C("o_orderkey").alias("message_id"), C("o_orderpriority").alias("subject"))
    files = v("lineitem").select(C("l_orderkey").alias("message_id"), (C("l_quantity") > 30).alias("stored"))
    return intake.intake_route(batch, files, ["High", "low"]).select("message_id", "status")


# Event types as paths, with limits over days so that the given events reach them.
EVENT_ROUTES = (("/purchase", 86400, 1), ("/signup", 172800, 2), ("/view", 86400, 1))
EVENT_DEFAULT = (86400, 2)
EVENT_RULE = """CASE WHEN event_type = 'purchase' THEN {'route': '/purchase', 'w': 86400, 'm': 1} WHEN event_type = 'signup' THEN {'route': '/signup', 'w': 172800, 'm': 2}
      WHEN event_type = 'view' THEN {'route': '/view', 'w': 86400, 'm': 1} ELSE {'route': '__default__', 'w': 86400, 'm': 2} END"""


@query("rate_limit", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, {EVENT_RULE} AS r FROM events),
    o AS MATERIALIZED (SELECT user_id, r.route AS route, r.w * CAST(1000000 AS BIGINT) AS w, r.m AS m, event_id, us, row_number() OVER (PARTITION BY user_id, r.route ORDER BY us, event_id) AS rn FROM e),
    d AS (SELECT user_id, route, event_id, rn, [us] AS log, true AS allowed, CAST(NULL AS BIGINT) AS retry_after FROM o WHERE rn = 1
      UNION ALL SELECT s.user_id, s.route, s.event_id, s.rn, CASE WHEN len(live) >= m THEN live ELSE list_append(live, us) END, len(live) < m,
        CASE WHEN len(live) >= m THEN (w - (us - live[1])) // 1000000 + 1 END
      FROM (SELECT o.*, list_filter(d.log, lambda x: x >= o.us - o.w) AS live FROM d JOIN o ON o.user_id = d.user_id AND o.route = d.route AND o.rn = d.rn + 1) s)
  SELECT CAST(user_id AS VARCHAR) AS client, route, event_id, allowed, retry_after FROM d""")
def _(v):
    """Requests by event type, in four batches by time."""
    folder = run.work_folder(v.spark, "rate")
    rows = v("events").select(C("user_id").alias("client"), "event_id", "ts", F.concat(F.lit("/"), "event_type").alias("path"))
    requests = run.batches_stream(rows, f"{folder}/in", [F.dayofmonth("ts") <= d for d in (7, 15, 22)])
    limits.rate_limit(limits.requests_of(requests, C("path"), EVENT_ROUTES, EVENT_DEFAULT), folder)
    return run.read_result(v.spark, folder).select("client", "route", "event_id", "allowed", "retry_after")


@query("first_open", "SELECT user_id, min(ts) AS first_open FROM events GROUP BY user_id")
def _(v):
    folder = run.work_folder(v.spark, "open")
    jobs.store_updates(jobs.first_open(_shuffled_stream(v, "events", "user_id % 3 = 0"), "user_id", "ts"), folder)
    return jobs.latest_updates(v.spark, folder, "user_id", "first_open")


@query("pause_stream", """WITH n AS (SELECT e.role_id, evaluation_id AS app_id, total_score >= min_fit_score AS qualified, shortlist_target,
      coalesce(sum(CASE WHEN total_score >= min_fit_score THEN 1 ELSE 0 END) OVER (PARTITION BY e.role_id ORDER BY evaluated_at, evaluation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM evals e JOIN roles r ON r.role_id = e.role_id)
  SELECT role_id, app_id, CASE WHEN before >= shortlist_target THEN 'queued' ELSE 'accepted' END AS decision, qualified FROM n""")
def _(v):
    folder = run.work_folder(v.spark, "pause")
    stream = run.batches_stream(_applications(v), f"{folder}/in", [F.year("ts") <= y for y in (1993, 1996)])
    limits.pause_stream(stream, _targets(v), folder)
    return run.read_result(v.spark, folder).select("role_id", "app_id", "decision", "qualified")


def _applications(v):
    return v("orders").select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("role_id"), C("o_orderkey").alias("app_id"),
        C("o_orderdate").alias("ts"),
        F.least(F.floor(C("o_totalprice") / 450 + 0.5) / 10, F.lit(100.0)).alias("score"))


def _targets(v):
    return v("roles").select("role_id", "min_fit_score", C("shortlist_target").alias("target"))


# Batches: to 1994, to 1996, the rest. Odd roles are resumed with the second batch and a target 50 higher.
RESUMED = """app AS (SELECT e.role_id, evaluation_id AS app_id, evaluated_at AS ts, total_score >= min_fit_score AS good, shortlist_target AS target,
      CASE WHEN year(evaluated_at) <= 1994 THEN 0 WHEN year(evaluated_at) <= 1996 THEN 1 ELSE 2 END AS b FROM evals e JOIN roles r ON r.role_id = e.role_id),
    before0 AS (SELECT *, coalesce(sum(good::INT) OVER (PARTITION BY role_id ORDER BY ts, app_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n0,
      row_number() OVER (PARTITION BY role_id ORDER BY ts, app_id) AS p0 FROM app WHERE b = 0),
    d0 AS (SELECT *, p0 = 1 OR n0 < target AS ok FROM before0),
    s0 AS (SELECT role_id, count(*) FILTER (ok AND good) AS q0 FROM d0 GROUP BY role_id),
    rest AS (SELECT role_id, app_id, ts, good, target, 1 AS b, true AS again FROM d0 WHERE NOT ok AND role_id % 2 = 1 UNION ALL SELECT role_id, app_id, ts, good, target, b, false FROM app WHERE b > 0),
    before1 AS (SELECT rest.*, coalesce(q0, 0) + coalesce(sum(good::INT) OVER (PARTITION BY rest.role_id ORDER BY b, again DESC, ts, app_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n1,
      row_number() OVER (PARTITION BY rest.role_id ORDER BY b, again DESC, ts, app_id) AS p1, coalesce(q0, 0) AS q0 FROM rest LEFT JOIN s0 ON s0.role_id = rest.role_id),
    d1 AS (SELECT *, CASE WHEN role_id % 2 = 1 THEN p1 = 1 OR n1 < target + 50 ELSE n1 < target END AS ok FROM before1),
    final AS (SELECT role_id, app_id, ok, good FROM d1 UNION ALL SELECT role_id, app_id, ok, good FROM d0 WHERE ok OR role_id % 2 = 0)"""


def _resumed(v, name):
    folder = run.work_folder(v.spark, name)
    stream = run.batches_stream(_applications(v), f"{folder}/in", [F.year("ts") <= y for y in (1994, 1996)])
    controls = _targets(v).where("role_id % 2 = 1").select("role_id", F.lit(1).alias("batch_id"), (C("target") + 50).alias("target"))
    limits.pause_stream(stream, _targets(v), folder, controls)
    return limits.latest_decisions(run.read_result(v.spark, folder))


@query("pause_resume", f"WITH {RESUMED} SELECT role_id, app_id, CASE WHEN ok THEN 'accepted' ELSE 'queued' END AS decision, good AS qualified FROM final")
def _(v):
    return _resumed(v, "resume").select("role_id", "app_id", "decision", "qualified")


@query("drain_queue", f"WITH {RESUMED} SELECT role_id, app_id, good AS qualified FROM final WHERE NOT ok AND role_id <= 3")
def _(v):
    """What waits for the first three roles after the run."""
    return limits.drain_queue(_resumed(v, "drain"), v("roles").where("role_id <= 3")).select("role_id", "app_id", "qualified")


@query("daily_stream", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS count FROM events GROUP BY 1")
def _(v):
    folder = run.work_folder(v.spark, "daily")
    jobs.store_daily(_shuffled_stream(v, "events"), "ts", folder)
    return jobs.daily_totals(v.spark, folder)


@query("incremental_scoring", """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS words FROM documents)
  SELECT doc_id, CAST(0 AS BIGINT) AS role_id, CAST(least(100, count(term)) AS DOUBLE) AS total_score FROM t LEFT JOIN dict_terms ON list_contains(words, term) GROUP BY doc_id""")
def _(v):
    folder = run.work_folder(v.spark, "score")
    docs = _stream(v, "documents")
    pairs = docs.select("doc_id", F.lit(0).cast("long").alias("role_id"), "text")
    terms = v("dict_terms").select("term")

    def score(batch):
        words = batch.select("doc_id", "role_id", F.explode(F.array_distinct(
            F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0))).alias("term"))
        hits = words.join(terms, "term").groupBy("doc_id", "role_id").agg(F.count(F.lit(1)).alias("n"))
        return batch.select("doc_id", "role_id").join(hits, ["doc_id", "role_id"], "left").select(
            "doc_id", "role_id", F.least(F.lit(100.0), F.coalesce("n", F.lit(0)).cast("double")).alias("total_score"),
            F.lit(None).cast("string").alias("eval_status"))

    jobs.score_stream(pairs, folder, score)
    return run.read_result(v.spark, folder).select("doc_id", "role_id", "total_score")
