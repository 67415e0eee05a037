import csv
import random

from corpusfit.sources import readers


def _rows(frame):
    return {(r.file.rsplit("/", 1)[1], r.row_no): r for r in frame.collect()}


def test_records_over_several_splits(spark, tmp_path):
    """Fields with commas, doubled quotes and line ends, against the csv module; splits of 2,000 bytes."""
    rng = random.Random(3)
    want = {}
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["Name", "Note"])
            line = 2
            for k in range(1500):
                note = "".join(rng.choices(["x", "a,b", '"', "\n", "\n\n", "é", " y "], k=rng.randint(1, 9)))
                writer.writerow([f"n{k}", note])
                want[name, line] = (f"n{k}", note.strip())
                line += 1 + note.count("\n")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows, bad = readers.read_import_csv(spark, str(tmp_path))
        assert {k: (r["name"], r.note) for k, r in _rows(rows).items()} == want
        assert bad.count() == 0
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)


def test_bad_records_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffName,Email\nAnn,a@x,more\n\nBob\nCy,\"c@x\nopen\nfor ever\n")
    (tmp_path / "b.csv").write_text("email, NAME ,name\ne@x,Eve,twice\n")
    (tmp_path / "c.csv").write_text("")
    rows, bad = readers.read_import_csv(spark, str(tmp_path))
    assert {k: (r["name"], r.email) for k, r in _rows(rows).items()} == {("a.csv", 4): ("Bob", ""), ("b.csv", 2): ("Eve", "e@x")}
    assert {k: (r.lines, r.reason) for k, r in _rows(bad).items()} == {
        ("a.csv", 2): (1, "more values than headers"), ("a.csv", 5): (3, "quote is not closed")}


def test_long_records_are_bounded(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name\n\"" + "x\n" * 50 + "\"\nz\n")
    rows, bad = readers.read_import_csv(spark, str(tmp_path), most_lines=20)
    assert [r["name"] for r in rows.collect()] == ["z"]
    assert [(r.row_no, r.lines) for r in bad.collect()] == [(2, 51)]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    rows, bad = readers.read_import_csv(spark, str(tmp_path))
    assert rows.count() == 0 and bad.count() == 0
