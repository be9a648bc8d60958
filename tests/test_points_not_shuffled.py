"""Spectra of intervals shuffle intervals, not the points of their even grid."""

import time

from pairwave.operators import spectra


def _records(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_band_powers_shuffle_no_grid_point(spark):
    rows = [(key, 20.0 * i, 800.0 + (i * 37 + key) % 90) for key in range(20) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, t double, rr double")
    before, limit = _records(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables that are not small
    try:
        made = spectra.band_powers(df, ["key"], "t", "rr").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    time.sleep(1)  # the store hears of stages a little later
    assert len(made) == 20 and all(r.n == 4720 and r.lf > 0 for r in made)
    # 1,200 intervals make 94,400 points; a few rows each are shuffled of intervals, and 25 of a series' powers
    assert _records(spark) - before < 40_000
