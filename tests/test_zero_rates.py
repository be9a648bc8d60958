"""A heart rate of zero has no interval: it is one of the rates, and not plausible; an unknown one is no rate."""

from pyspark.sql import functions as F

from pairwave.operators import summary


def test_zero_rate_is_not_plausible(spark):
    df = spark.createDataFrame([("s", 0.0, 0.0), ("s", 1.0, 60.0), ("s", 2.0, 70.0), ("s", 3.0, 10.0), ("s", 4.0, None)], "k string, t double, x double")
    row = summary.segment_summary(df, ["k"], F.col("x"), "t").first()
    assert (row.n, row.plausible_percent, row.extreme_percent) == (4, 50.0, 50.0)
