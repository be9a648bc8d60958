"""Windows of merged panes against windows of copied rows."""

import random

import pytest
from pyspark.sql import functions as F

from pairwave.functions.stats import pearson
from pairwave.operators import panes, series, synchrony


def test_measure():
    assert panes.measure(30.0, 15.0) == (15.0, 2, 1) and panes.measure(30.0, 6.0) == (6.0, 5, 1)
    assert panes.measure(0.75, 0.5) == (0.25, 3, 2) and panes.measure(10, 15) == (5.0, 2, 3)


@pytest.mark.parametrize("width,step", [(30.0, 15.0), (30.0, 6.0), (10.0, 15.0), (0.75, 0.5), (500.0, 1.0)])
@pytest.mark.parametrize("whole_last", [True, False])
def test_against_copied_rows(spark, width, step, whole_last):
    g = random.Random(1)
    rows = [(k, 100 + i * 0.25, g.gauss(70, 5) if g.random() > 0.1 else None, g.gauss(80, 4)) for k, n in (("x", 500), (None, 301), ("short", 12), ("one", 1)) for i in range(n)]
    rows += [("flat", 100.0 + i, 70.1, float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, t double, a double, b double").repartition(4)
    dealt = series.sliding(df.where("a is not null and b is not null"), ["k"], width, step, whole_last=whole_last)
    want = dealt.groupBy("k", "window_index").agg(F.min("start").alias("start"), F.count("*").alias("n"), pearson(F.col("a"), F.col("b")).alias("r"))
    want = {(r.k, r.window_index): (r.start, r.n, r.r) for r in want.collect()}
    got = {(r.k, r.window_index): (r.start, r.n, r.r) for r in synchrony.windowed(df, ["k"], width, step, 1, whole_last=whole_last).collect()}
    assert set(got) == set(want)
    for key, (start, n, r) in want.items():
        assert got[key][:2] == (start, n) and got[key][2] == (None if r is None else pytest.approx(r, abs=1e-9)), key
    assert all(r is None for (k, _), (_, _, r) in got.items() if k == "flat")
