"""The query on surrogates looks at every window of the hourly grid, and no null value is shuffled."""

from pyspark.sql import functions as F

from pairwave.operators import transfer
from pairwave.plans import signals, standin


def test_every_window(spark, sf, monkeypatch):
    """Windows of 120 samples begin every 24 samples of a run; the query had one of 90 six-hourly samples a month."""
    seen = []
    monkeypatch.setattr(transfer, "surrogate_tests", lambda df, keys, order, **tests: seen.append((df, keys, tests)) or _empty(df, keys))
    signals.surrogates(spark, sf)
    df, keys, tests = seen[0]
    got = {(r.dyad, r.start): r.n for r in df.groupBy(*keys).agg(F.count("*").alias("n")).collect()}
    want = {}
    for dyad, ks in standin.dyads(spark, sf).groupBy("dyad").agg(F.sort_array(F.collect_list("k"))).collect():
        run = []
        for k in [*ks, None]:
            if run and (k is None or k != run[-1] + 1):
                want |= {(dyad, run[i] * 3600.0): 120 for i in range(0, len(run) - 119, 24)}
                run = []
            run.append(k)
    assert want and got == want and not tests


def _empty(df, keys):
    names = [n for x in transfer.NULLS for n in (x, f"{x}_mean", f"{x}_sd", f"{x}_z", f"{x}_p")]
    more = [F.lit(0).alias(n) for n in ("tau", "delta", "n_symbols", "few_symbols", "bias_ba", "bias_ab", *names)]
    return df.select(*keys, *more).limit(0)


def test_no_null_value_is_shuffled(spark):
    df = spark.range(60).selectExpr("0L as w", "id", "cast(hash(id) as double) as a", "cast(hash(id + 99) as double) as b")
    out = transfer.surrogate_tests(df, ["w"], "id", taus=[1, 2], surrogates=7, shuffles=2, chunk=3)
    assert out._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 1
    rows = out.collect()
    assert [r.tau for r in rows] == [1, 2] and all(0 < r.ste_ba_p <= 1 for r in rows)
