"""A recording is made once, though the scan that places its samples reads it twice."""

from pyspark.sql import functions as F

from pairwave.operators import ecg


def test_placed_does_not_make_its_samples_twice(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("t"), (F.col("id") * 1.5).alias("x"))
    out = ecg.placed(df, ["k"], span=10.0)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.k, r.i, r.t, r.x) for r in out.collect()} == {(n % 2, n // 2, float(n), n * 1.5) for n in range(100)}
