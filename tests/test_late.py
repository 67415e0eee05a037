"""Late rows beside the landing: batches out of order, repeats across batches, rows without a time."""

from datetime import datetime

from corpusfit.streaming import intake, run


def test_late_rows_are_kept_and_counted(spark):
    day = lambda d: datetime(2024, 1, d) if d else None
    batches = [[("a", 10), ("b", 1), ("n", None)], [("a", 9), ("c", 20), ("b", 2)], [("d", 8), ("e", 16), ("c", 20), ("a", 15), ("n", None)], [("f", 15), ("f", 14)]]
    rows = spark.createDataFrame(
        [(m, day(d), k) for k, b in enumerate(batches) for m, d in b], "message_id string, received_at timestamp, part int")
    folder = run.work_folder(spark, "late-test")
    stream = run.batches_stream(rows, f"{folder}/in", [rows["part"] == k for k in range(3)])
    intake.land_with_late(stream, folder, "message_id", "received_at", 5 * 86400)
    landed = sorted((r.message_id, r.batch_id, r.received_at and r.received_at.day) for r in run.read_result(spark, folder).collect())
    # "a" comes again within two delays of the newest time, so it lands once.
    assert landed == [("a", 0, 10), ("b", 0, 1), ("c", 1, 20), ("e", 2, 16), ("f", 3, 15), ("n", 0, None)]
    late = {(r.batch_id, r.late) for r in intake.late_counts(spark, folder).collect()}
    assert late == {(1, 1), (2, 1), (3, 1)}
    assert {r.message_id for r in spark.read.parquet(f"{folder}/late").collect()} == {"b", "d", "f"}
