"""Request limits and intake targets over several batches, against the sequential rules."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusfit.streaming import limits, run

RULES = (("/a", 10, 2), ("/b", 30, 3))
DEFAULT = (20, 1)


def rule_of(path):
    return next(((p, s, n) for p, s, n in RULES if path.startswith(p)), ("__default__", *DEFAULT))


def plain(batches):
    """Sequential sliding logs; a row counts at the latest time of earlier batches at least."""
    logs, clock, out = defaultdict(list), 0, {}
    for batch in batches:
        rows = sorted((max(t, clock), e, c, p) for c, e, t, p in batch)
        for t, e, c, p in rows:
            route, seconds, most = rule_of(p)
            log = logs[c, route] = [x for x in logs[c, route] if x >= t - seconds]
            if len(log) >= most:
                out[e] = (False, seconds - (t - log[0]) + 1)
            else:
                log.append(t)
                out[e] = (True, None)
        clock = max([clock, *(t for t, *_ in rows)])
    return out


def requests(seed, n, span, clients):
    rng = random.Random(seed)
    return [(rng.choice(clients), k, rng.randrange(span), rng.choice(["/a/x", "/b", "/c"])) for k in range(n)]


def as_stream(spark, folder, batches, kind="client string, event_id long, s int, path string"):
    for batch in batches:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(folder)
    return run.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)


def decided(spark, batches):
    folder = run.work_folder(spark, "rate-test")
    stream = as_stream(spark, f"{folder}/in", batches).withColumn("ts", F.timestamp_seconds("s"))
    limits.rate_limit(limits.requests_of(stream, F.col("path"), RULES, DEFAULT), folder)
    rows = run.read_result(spark, folder).collect()
    assert len(rows) == sum(map(len, batches))
    return {r.event_id: (r.allowed, r.retry_after) for r in rows}, folder


def test_batches_in_and_out_of_order(spark):
    rows = requests(1, 500, 900, ["x", "y", "z", "z", "z"])
    in_time = sorted(rows, key=lambda r: r[2])
    batches = [in_time[:150], in_time[150:300], in_time[300:]]
    assert decided(spark, batches)[0] == plain(batches)
    mixed = [rows[:120], rows[120:300], rows[300:420], rows[420:]]
    assert decided(spark, mixed)[0] == plain(mixed)


def test_batches_equal_one_pass(spark):
    rows = sorted(requests(2, 300, 2000, ["x", "y"]), key=lambda r: r[2])
    assert plain([rows]) == plain([rows[:100], rows[100:101], rows[101:]]) == decided(spark, [rows[:100], rows[100:101], rows[101:]])[0]


def test_silent_clients_are_forgotten(spark):
    batches = [[("old", 1, 0, "/a"), ("old", 2, 1, "/b")], [("new", 3, 25, "/a")], [("new", 4, 40, "/a")]]
    _, folder = decided(spark, batches)
    kept = [{(r.client, r.route) for r in spark.read.parquet(f"{folder}/state/batch_id={k}").collect()} for k in range(3)]
    assert kept == [{("old", "/a"), ("old", "/b")}, {("old", "/b"), ("new", "/a")}, {("new", "/a")}]


def test_only_crowded_pieces_reach_python_and_hot_clients_are_cut(spark):
    # A client with bursts of two (allowed) far apart, and one burst of five.
    rows = [("hot", 10 * k + j, 100 * k + j, "/a") for k in range(60) for j in range(2)] + [("hot", 9000 + j, 5000 + j, "/a") for j in range(5)]
    frame = limits.requests_of(
        spark.createDataFrame(rows, "client string, event_id long, s int, path string").withColumn("ts", F.timestamp_seconds("s")), F.col("path"), RULES, DEFAULT)
    carried = spark.createDataFrame([], limits.STAMP)
    pieces = limits.pieces_of(frame, carried)
    assert pieces.select("piece").distinct().count() == 60
    assert {r.event_id for r in pieces.where("dense").collect()} == {500, 501, *range(9000, 9005)}
    # Two neighbouring slots may hold more than the limit without any window that does.
    loose = [("c", k, t, "/a") for k, t in enumerate((1, 9, 19, 29, 39))]
    loose = limits.requests_of(spark.createDataFrame(loose, "client string, event_id long, s int, path string").withColumn("ts", F.timestamp_seconds("s")), F.col("path"), (("/a", 10, 2),), DEFAULT)
    dense = limits.pieces_of(loose, carried)
    assert limits._crowded(dense).count() == 0 and all(r.allowed for r in limits.decide(loose, carried).collect())


def test_client_address(spark):
    rows = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "p"), ("", "p"), (None, "p"), (None, None)], "f string, p string")
    assert [r.c for r in rows.select(limits.client_of(F.col("f"), F.col("p")).alias("c")).collect()] == ["1.1.1.1", "p", "p", "unknown"]


def plain_pause(batches, targets, controls):
    """One application after another; a resumed role takes its queue first."""
    state = {r: [0, False, t] for r, (_, t) in targets.items()}
    queue, out = defaultdict(list), {}
    for k, batch in enumerate(batches):
        todo = defaultdict(list)
        for role, b, target in controls:
            if b == k:
                state[role][1:] = [False, target]
                todo[role] = sorted(queue.pop(role, []))
        for role, app, ts, score in sorted(batch, key=lambda r: (r[2], r[1])):
            todo[role].append((ts, app, score))
        for role, rows in todo.items():
            for ts, app, score in rows:
                if state[role][1]:
                    out[role, app] = "queued"
                    queue[role].append((ts, app, score))
                    continue
                out[role, app] = "accepted"
                state[role][0] += score >= targets[role][0]
                state[role][1] = state[role][2] is not None and state[role][0] >= state[role][2]
    return out


@pytest.mark.parametrize("controls", [[], [(1, 1, 12), (2, 2, 3), (3, 1, None)], [(1, 1, 9), (1, 2, 30), (2, 1, 0)]])
def test_pause_resume_and_drain(spark, controls):
    rng = random.Random(4)
    apps = [(rng.choice([1, 1, 1, 2, 3]), k, rng.randrange(50), float(rng.randrange(100))) for k in range(160)]
    batches = [apps[:60], apps[60:100], apps[100:]]
    targets = {1: (40.0, 8), 2: (50.0, 2), 3: (10.0, 5)}
    folder = run.work_folder(spark, "pause-test")
    stream = as_stream(spark, f"{folder}/in", batches, "role_id int, app_id long, ts int, score double")
    frame = spark.createDataFrame([(r, m, t) for r, (m, t) in targets.items()], "role_id int, min_fit_score double, target long")
    given = spark.createDataFrame(controls, "role_id int, batch_id int, target long") if controls else None
    limits.pause_stream(stream, frame, folder, given)
    rows = limits.latest_decisions(run.read_result(spark, folder)).collect()
    want = plain_pause(batches, targets, controls)
    assert {(r.role_id, r.app_id): r.decision for r in rows} == want
    waiting = limits.drain_queue(limits.latest_decisions(run.read_result(spark, folder)), frame.where("role_id = 1")).collect()
    assert {r.app_id for r in waiting} == {a for (r, a), d in want.items() if r == 1 and d == "queued"}


def test_ten_million_places_need_no_list(spark):
    batch = spark.range(3000).select(F.lit(1).alias("role_id"), F.col("id").alias("app_id"), F.col("id").alias("ts"), F.lit(90.0).alias("score"))
    targets = spark.createDataFrame([(1, 50.0, 10_000_000)], "role_id int, min_fit_score double, target long")
    so_far = spark.createDataFrame([(1, 9_998_000, False)], "role_id int, qualified long, paused boolean")
    got = limits.pause_decisions(batch, so_far, targets)
    assert got.where("decision = 'accepted'").count() == 2000 and "collect_list" not in got._jdf.queryExecution().toString()
