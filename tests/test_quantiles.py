"""Exact quantiles against Spark's and NumPy's, with ties, few and many buckets, nulls and infinite ranges of sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave.operators import quantiles

SHARES = [0.0, 0.005, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("buckets,ranks", [(4096, 100_000), (2, 100_000), (3, 0)])
def test_against_numpy(spark, monkeypatch, buckets, ranks):
    monkeypatch.setattr(quantiles, "MOST_RANKS", ranks)
    g = random.Random(5)
    data = {
        "normal": [g.gauss(0, 1) for _ in range(500)],
        "ties": [float(g.randrange(3)) for _ in range(301)],
        "wide": [g.choice([-1, 1]) * 10.0 ** g.randrange(-12, 13) for _ in range(200)],
        None: [1.5, 2.5],
        "one": [7.0],
        "none": [],
    }
    rows = [(k, v, -v) for k, x in data.items() for v in x] + [(k, None, None) for k in data] + [("half", 3.0, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    got = {(r.k, r.metric, r.share): r.value for r in quantiles.quantiles(df, ["k"], ["a", "b"], SHARES, buckets).collect()}
    want = {(k, m, p): np.quantile(np.array(x) * s, p) for k, x in [*data.items()] if x for m, s in (("a", 1), ("b", -1)) for p in SHARES}
    want |= {("half", "a", p): 3.0 for p in SHARES}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-300) for k in want)


def test_as_spark_s_percentile(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = {(r.l_returnflag, r.metric): r.value for r in quantiles.quantiles(df, ["l_returnflag"], ["l_quantity", "l_extendedprice"], [0.5]).collect()}
    want = df.groupBy("l_returnflag").agg(*[F.percentile(m, F.lit(0.5)).alias(m) for m in ("l_quantity", "l_extendedprice")]).collect()
    assert got == {(r.l_returnflag, m): r[m] for r in want for m in ("l_quantity", "l_extendedprice")}
