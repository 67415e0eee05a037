from corpusfit.catalog import streams
from corpusfit.catalog.views import Inputs
from corpusfit.streaming import run


def test_a_streamed_table_may_be_a_file_or_a_folder(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    rows.write.parquet(f"{tmp_path}/folder/labels.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "file").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    for kind in ("folder", "file"):
        out = run.work_folder(spark, kind)
        run.run_once(streams._stream(Inputs(spark, f"{tmp_path}/{kind}"), "documents"), out)
        assert sorted(r.doc_id for r in run.read_result(spark, out).collect()) == list(range(100))
