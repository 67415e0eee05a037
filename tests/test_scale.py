from pyspark.sql import functions as F

from corpusfit.scale import salted_join


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_the_right_side_are_not_broadcast(spark):
    left = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    right = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        joined = salted_join(left, right, "k", how)
        assert "Broadcast" not in final_plan(joined)
        assert {(r.k, r.id, r.v) for r in joined.collect()} == {(i % 7, i, i % 7 * 10) for i in range(3000)}
        assert joined.count() == 3000
