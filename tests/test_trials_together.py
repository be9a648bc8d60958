"""Trials of one length at once give what each gives on its own."""

import numpy as np

from pyspark.sql import functions as F

from pairwave.functions import stats
from pairwave.operators import signal, synchrony, transfer


def trials(spark):
    r, rows = np.random.default_rng(3), []
    for trial, n in enumerate((5, 10, 11, 48, 48, 48, 30)):
        a, b = r.normal(50, 20, n).round(1), r.normal(80, 30, n).round(0)
        if trial == 4:
            a = 3.0 + 2 * np.arange(n)
        rows += [("d", trial, int(k), float(a[k]), float(b[k])) for k in r.permutation(n)]
    return spark.createDataFrame(rows, "dyad string, trial long, k long, a double, b double")


def test_phases(spark):
    df = trials(spark)
    alone = signal.by_key(df, ["dyad", "trial"], "k", ["a", "b"], signal.phases, "n long, plv double, pli double, mean_phase double, envelope_r double")
    names = ("n", "plv", "pli", "mean_phase", "envelope_r")
    rounded = lambda d: sorted((r.trial, *(round(r[c], 9) for c in names)) for r in d.collect())
    got = rounded(signal.phases_by_key(df, ["dyad", "trial"], "k"))
    assert got == rounded(alone.where("error is null and n >= 10")) and [r[0] for r in got] == [1, 2, 3, 5, 6]


def test_transfer(spark):
    df, taus = trials(spark), [1, 2, 5, 13]
    names = ("tau", "ste_ab", "ste_ba", "h_ab", "h_ba", "asymmetry")
    rounded = lambda d: sorted((r.trial, *(round(r[c], 9) + 0.0 for c in names)) for r in d.collect())
    assert rounded(transfer.transfer_of_trials(df, ["dyad", "trial"], "k", taus)) == rounded(transfer.transfer_by_tau(df, ["dyad", "trial"], "k", taus))


def test_no_row_stands_for_a_state(spark):
    df = trials(spark)
    plan = transfer.transfer_of_trials(df, ["dyad", "trial"], "k", [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_both_correlations_from_one_pass(spark):
    d = trials(spark)
    out = synchrony.spearman(d, ["dyad", "trial"], plain="r")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    want = {r.trial: r.r for r in d.groupBy("trial").agg(stats.pearson(F.col("a"), F.col("b")).alias("r")).collect()}
    same = lambda x: None if x is None else round(x, 12)
    assert {r.trial: same(r.r) for r in out.collect()} == {k: same(v) for k, v in want.items()}
    assert plan.count("Window [") == 2 and "Join" not in plan
