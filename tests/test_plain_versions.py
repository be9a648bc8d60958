"""Kernels and models against plain re-implementations: loops, dense matrices and numeric integrals."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwave.operators import mixed, pairing, signal, synchrony, transfer, trial
from pairwave.sources import files


def _symbols(x, dim, lag):
    out = []
    for i in range(len(x) - lag * (dim - 1)):
        part = [x[i + j * lag] for j in range(dim)]
        order = sorted(range(dim), key=lambda j: (part[j], j))
        rank = [0] * dim
        for place, j in enumerate(order):
            rank[j] = place + 1
        out.append(tuple(rank))
    return out


def _ste(source, target, delta):
    f, p, s = target[delta:], target[:-delta], source[:-delta]
    n = len(f)
    c1, c2, c3, c4 = (Counter(x) for x in (zip(f, p, s), zip(p, s), zip(f, p), p))
    ste = sum(c / n * (math.log2(c / n * c4[b] / n) - math.log2(c2[b, d] / n * c3[a, b] / n)) for (a, b, d), c in c1.items())
    return ste, -sum(c3[a, b] / n * (math.log2(c3[a, b] / n) - math.log2(c4[b] / n)) for a, b, d in c1)


@pytest.mark.parametrize("delta", [1, 3])
def test_transfer_entropy_by_counting(delta):
    rng = np.random.default_rng(delta)
    a, b = rng.integers(0, 4, 90).astype(float), rng.normal(size=(3, 90))
    taus = [1, 2, 5]
    ste, plain, none = transfer.Nulls(taus, 3, delta, 0, rng).both(a, b)
    biased = transfer.Nulls(taus, 3, delta, 4, np.random.default_rng(9))
    _, nste, taken = biased.both(a, b)
    again, bias = np.random.default_rng(9), np.zeros(ste.shape)
    for _ in range(4):
        pb, pa = again.permuted(b, axis=1), again.permuted(np.broadcast_to(a, b.shape), axis=1)
        for r in range(3):
            for i, t in enumerate(taus):
                bias[r, i, 0] += _ste(_symbols(pb[r], 3, t), _symbols(a, 3, t), delta)[0] / 4
                bias[r, i, 1] += _ste(_symbols(pa[r], 3, t), _symbols(b[r], 3, t), delta)[0] / 4
    assert not none.any() and taken == pytest.approx(bias, abs=1e-12)
    for r in range(3):
        for i, t in enumerate(taus):
            sa, sb = _symbols(a, 3, t), _symbols(b[r], 3, t)
            for way, (x, y) in enumerate(((sb, sa), (sa, sb))):
                want, h = _ste(x, y, delta)
                assert ste[r, i, way] == pytest.approx(want, abs=1e-12)
                assert plain[r, i, way] == pytest.approx(want / h, abs=1e-12)
                assert nste[r, i, way] == pytest.approx((want - bias[r, i, way]) / h, abs=1e-12)


def test_prediction_delay_by_sums():
    rng = np.random.default_rng(5)
    for shift in (0, 1, 4, 7):
        x = rng.normal(size=60)
        a, b = np.roll(x, shift), x
        ca, cb = a - a.mean(), b - b.mean()
        sums = {k: sum(ca[i + k] * cb[i] for i in range(60) if 0 <= i + k < 60) for k in range(-10, 11)}
        best = max(range(-10, 11), key=lambda k: (sums[k], -k))
        assert transfer.prediction_delay(a, b, 10) == max(1, best)


def test_windows_of_runs(spark):
    rng = np.random.default_rng(1)
    rows = [("d", 0.25 * i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(400, 2))) if i != 150]
    df = spark.createDataFrame(rows, "k string, t double, a double, b double")
    got = transfer.ste_windows(df, ["k"], "t", 0.25, taus=[1, 60], surrogates=0, shuffles=2).collect()
    assert {(r.run, r.window, r.start) for r in got} == {(1, 0, 0.0), (1, 1, 6.0), *[(2, w, 37.75 + 6 * w) for w in range(6)]}
    assert all(r.tau == 1 and r.ste_ab_p is None and r.ste_ab > 0 for r in got)
    assert all(r.end == r.start + 119 * 0.25 and r.centre == r.start + 60 * 0.25 for r in got)


def test_summaries_of_surrogates_by_hand(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 60))
    df = spark.createDataFrame([("k", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "k string, i long, a double, b double")
    got = {r.tau: r for r in transfer.surrogate_tests(df, ["k"], "i", taus=[1, 3], surrogates=25, shuffles=2, chunk=10, seed=7).collect()}
    delta = transfer.prediction_delay(a, b, 13)
    ste, nste, bias = transfer.Nulls([1, 3], 3, delta, 2, np.random.default_rng(transfer.seed_of(7, "k", "observed"))).both(a, b)
    nulls = [[], []]
    for part, count in enumerate((10, 10, 5)):
        r = np.random.default_rng(transfer.seed_of(7, "k", part))
        moved = r.permuted(np.tile(b, (count, 1)), axis=1)
        for kept, x in zip(nulls, transfer.Nulls([1, 3], 3, delta, 2, r).both(a, moved)):
            kept.append(x)
    nulls = [np.concatenate(x) for x in nulls]
    for i, tau in enumerate((1, 3)):
        row = got[tau]
        assert (row.bias_ba, row.bias_ab) == pytest.approx(tuple(bias[0, i])) and row.n_symbols == 60 - 2 * tau - delta
        for name, seen, null in (("ste", ste[0, i], nulls[0][:, i]), ("nste", nste[0, i], nulls[1][:, i])):
            for tag, o, x in (("ba", seen[0], null[:, 0]), ("ab", seen[1], null[:, 1]), ("asymmetry", seen[0] - seen[1], null[:, 0] - null[:, 1])):
                mean = sum(x) / 25
                sd = math.sqrt(sum((v - mean) ** 2 for v in x) / 25)
                above = sum(abs(v - mean) >= abs(o - mean) for v in x) if tag == "asymmetry" else sum(v >= o for v in x)
                want = (o, mean, sd, (o - mean) / sd, (above + 1) / 26)
                assert tuple(row[f"{name}_{tag}{e}"] for e in ("", "_mean", "_sd", "_z", "_p")) == pytest.approx(want)


def test_windows_that_failed_say_why(spark):
    rng = np.random.default_rng(1)
    rows = [("good", 0.25 * i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(200, 2)))]
    rows += [("still", 0.25 * i, 1.0 if i < 130 else float(i % 7), float(i % 5) + (i > 60) * (i % 3)) for i in range(200)]
    rows += [("short", 0.25 * i, float(i % 4), float(i % 3)) for i in range(50)] + [("flat", 0.25 * i, 2.0, float(i)) for i in range(150)] + [("none", 0.0, None, 1.0), (None, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, t double, a double, b double")
    results = transfer.ste_windows(df, ["k"], "t", 0.25, taus=[1, 2], surrogates=0, shuffles=1)
    got = {r.k: (r.status, r.n_rows, r.error) for r in transfer.ste_manifest(df, ["k"], "t", 0.25, results).collect()}
    lacking = "No contiguous valid paired HR samples"
    assert got == {
        "good": ("success", 8, ""), "still": ("success", 8, ""), "short": ("failed", 0, "No valid window/tau combinations after length and quality checks"),
        "flat": ("failed", 0, "No non-constant contiguous paired HR segment"), "none": ("failed", 0, lacking), None: ("failed", 0, lacking),
    }
    # a window that is constant within a run that isn't stays
    assert results.where("k = 'still' and window = 0").first().ste_ba == 0.0


def test_recurrence_by_the_whole_picture():
    rng = np.random.default_rng(2)
    a, b = np.sin(np.arange(70) / 3) + 0.05 * rng.normal(size=70), np.sin(np.arange(70) / 3 + 0.4)
    x, y = signal.standardised(a), signal.standardised(b)
    n = 68
    near = [[sum((x[i + k] - y[j + k]) ** 2 for k in range(3)) <= 0.4**2 for j in range(n)] for i in range(n)]

    def stretches(lines):
        out = []
        for line in lines:
            run = 0
            for v in [*line, False]:
                if v:
                    run += 1
                elif run:
                    out.append(run)
                    run = 0
        return out

    d = [v for v in stretches([[near[i][i + k] for i in range(n) if 0 <= i + k < n] for k in range(1 - n, n)]) if v >= 2]
    v = [c for c in stretches([[near[i][j] for i in range(n)] for j in range(n)]) if c >= 2]
    total = sum(map(sum, near))
    shares = [c / len(d) for c in Counter(d).values()]
    want = {"rr": total / n**2, "det": sum(d) / total, "l_mean": sum(d) / len(d), "l_max": max(d), "entropy": -sum(p * math.log(p) for p in shares), "lam": sum(v) / total, "tt": sum(v) / len(v)}
    assert signal.cross_recurrence(a, b, radius=0.4) == pytest.approx(want)


def _integral(f, low, high, n=20001):
    x = np.linspace(low, high, n)
    y = f(x)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


def test_p_values_of_arrays():
    rng = np.random.default_rng(8)
    r, n = rng.uniform(-1, 1, 3000) ** 3, rng.integers(0, 400, 3000)
    r[:6], n[:6] = [0.0, 1.0, -1.0, np.nan, 1.1, 0.5], [9, 9, 9, 9, 9, 3]
    want = [signal.t_test_p(a, int(b)) for a, b in zip(r, n)]
    got, clear = signal.t_test_ps(r, n), ~(np.abs(r) < 1e-3)
    np.testing.assert_allclose(got[clear], np.array(want)[clear], rtol=1e-9, atol=1e-12)
    # near zero, where the plain one loses digits of r, the density there says it
    for a, b, p in zip(r[~clear], n[~clear], got[~clear]):
        if b > 2 and abs(a) < 1e-5:
            top = math.exp(math.lgamma((b - 1) / 2) - math.lgamma((b - 2) / 2)) / math.sqrt(math.pi)
            assert p == pytest.approx(1 - 2 * top * abs(a), abs=1e-12)
    # of many samples a normal distribution
    many, t = 10_000_000, np.array([0.1, 1.0, 1.96, 3.0, 6.0])
    np.testing.assert_allclose(signal.t_test_ps(t / np.sqrt(many + t * t), np.full(5, many)), [math.erfc(v / math.sqrt(2)) for v in t], rtol=1e-4)
    assert len(signal.t_test_ps(np.array([]), np.array([]))) == 0


def test_p_values_by_integrals():
    for r, n in ((0.3, 20), (-0.62, 9), (0.05, 100)):
        df = n - 2
        t = abs(r) * math.sqrt(df / (1 - r * r))
        c = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2)
        inner = _integral(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), 0, t)
        assert signal.t_test_p(r, n) == pytest.approx(1 - 2 * inner, abs=1e-6)
    d1, d2, f = 4, 30, 2.3
    beta = math.gamma(d1 / 2) * math.gamma(d2 / 2) / math.gamma((d1 + d2) / 2)
    inner = _integral(lambda x: (d1 / d2) ** (d1 / 2) * x ** (d1 / 2 - 1) * (1 + d1 * x / d2) ** (-(d1 + d2) / 2) / beta, 0, f)
    assert signal.f_test_p(f, d1, d2) == pytest.approx(1 - inner, abs=1e-6)


def test_granger_by_normal_equations():
    rng = np.random.default_rng(7)
    a = rng.normal(size=150)
    b = np.concatenate(([0.0, 0.0], a[:-2])) + rng.normal(size=150)
    z = lambda s: (s - s.mean()) / s.std()

    def p(cause, effect, k):
        rows = range(k, len(effect))
        y = np.array([effect[i] for i in rows])

        def rest(columns):
            x = np.array([[1.0, *(s[i - j] for s in columns for j in range(1, k + 1))] for i in rows])
            return float(((y - x @ np.linalg.inv(x.T @ x) @ x.T @ y) ** 2).sum())

        small, full, free = rest([effect]), rest([effect, cause]), len(y) - 2 * k - 1
        return signal.f_test_p((small - full) / k / (full / free), k, free)

    got = signal.granger(a, b)
    assert got["p_ab"] == pytest.approx(min(p(z(a), z(b), k) for k in range(1, 6)), rel=1e-6)
    assert got["p_ba"] == pytest.approx(min(p(z(b), z(a), k) for k in range(1, 6)), rel=1e-6)
    assert got["direction"] in ("A", "both")


def test_mixed_model_by_dense_matrices(spark):
    rng = np.random.default_rng(11)
    g = np.repeat(np.arange(15), rng.integers(1, 9, 15))
    x = rng.normal(size=len(g))
    y = 0.7 * x + 1.5 * rng.normal(size=15)[g] + 0.5 * rng.normal(size=len(g))
    design = np.stack([np.ones(len(g)), x], axis=1)

    def minus_two_reml(theta):
        v = np.eye(len(g)) + theta * (g[:, None] == g[None])
        w = np.linalg.inv(v)
        a = design.T @ w @ design
        beta = np.linalg.solve(a, design.T @ w @ y)
        e = y - design @ beta
        s2 = e @ w @ e / (len(g) - 2)
        return (len(g) - 2) * math.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], beta, s2, s2 * np.linalg.inv(a)

    grid = np.geomspace(0.01, 100, 4001)
    theta = grid[int(np.argmin([minus_two_reml(t)[0] for t in grid]))]
    _, beta, s2, cov = minus_two_reml(theta)
    df = spark.createDataFrame([(int(p), float(u), float(v)) for p, u, v in zip(g, x, y)], "p long, x double, y double").withColumn("s", F.lit("all"))
    got = mixed.fit(df, ["s"], "y", "x", "p").first()
    assert (got.n, got.persons, got.singular, got.error) == (len(g), 15, False, None)
    assert got.beta == pytest.approx(beta[1], rel=1e-4) and got.se == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-3)
    assert got.var_rest == pytest.approx(s2, rel=2e-3) and got.var_person == pytest.approx(theta * s2, rel=5e-3)
    assert 3 < got.df < len(g)
    flat = mixed.fit(df.withColumn("x", F.lit(1.0)), ["s"], "y", "x", "p").first()
    assert flat.error.startswith("ValueError")


def test_roles_and_candidates(spark):
    df = spark.createDataFrame([(["x1204", "y77"], "1204", "77"), (["x1204", "y77"], "2204", "77"), (["a5", "b5"], "5", ""), (["q"], "7", "8")], "s array<string>, a string, b string")
    got = df.select(*[c.alias(k) for k, c in pairing.sensor_roles(F.col("s"), F.col("a"), F.col("b")).items()]).collect()
    assert tuple(got[0]) == ("x1204", "y77", "")
    assert tuple(got[1]) == ("x1204", "y77", "Inferred sensor_A as remaining folder sensor.")
    assert tuple(got[2]) == ("b5", "a5", "Inferred sensor_B as remaining folder sensor.")
    assert tuple(got[3]) == ("", "", "Could not resolve sensor_A. Could not resolve sensor_B.")


def _units(spark, rows):
    return spark.createDataFrame(rows, "recording_folder string, candidate_window long, condition string, s string, e string, a string, b string, timestamp_id string")


def test_validation(spark):
    good = [("f", 1, "FF", "1.0", "2.0", "7", "8", "30"), ("f", 2, "FE", "3", "4.5", "7", "8", "31")]
    check = lambda rows, seq=None: files.validated(_units(spark, rows), ["s", "e"], "s", "e", ["a", "b"], sequences=seq)
    assert check(good, {"f": [30, 31]}).count() == 2
    for row, words in ((("f", 3, "Unknown", "1", "2", "7", "8", None), "unknown condition"), (("f", 3, "FF", "x", "2", "7", "8", None), "without a number in s"), (("f", 3, "FF", "2", "2", "7", "8", None), "not after"), (("f", 3, "FF", "1", "2", " ", "8", None), "blank sensor")):
        with pytest.raises(ValueError, match=words):
            check([*good, row])
    with pytest.raises(ValueError, match="ids"):
        check(good, {"f": [31, 30]})
    with pytest.raises(ValueError, match="no rows"):
        check(_units(spark, good).where("false").collect())
    with pytest.raises(ValueError, match="missing"):
        files.validated(_units(spark, good), ["absent"], "s", "e", ["a", "b"])


def test_manifests_are_taken_up_again(spark, tmp_path):
    inputs = spark.createDataFrame([(f"{i}.csv",) for i in range(4)], "file string")
    assert files.pending(inputs, None).count() == 4
    folder = str(tmp_path / "manifest")
    files.append_manifest(spark.createDataFrame([("0.csv", "success", 5, ""), ("1.csv", "failed", 0, "why")], "file string, status string, n_rows long, error string"), folder, "r1")
    assert sorted(r.file for r in files.pending(inputs, spark.read.parquet(folder)).collect()) == ["1.csv", "2.csv", "3.csv"]
    assert files.pending(inputs, spark.read.parquet(folder), again=False).count() == 2
    rows = spark.createDataFrame([("a", "01", 1.0), ("a", "02", 2.0), ("b", "01", 3.0)], "k string, w string, v double")
    out = str(tmp_path / "segments")
    assert {r.status for r in files.write_new_segments(rows.where("k = 'a'"), out, ["k", "w"]).collect()} == {"saved"}
    again = {(r.k, r.w): r.status for r in files.write_new_segments(rows, out, ["k", "w"]).collect()}
    assert again == {("a", "01"): "skipped_existing_file", ("a", "02"): "skipped_existing_file", ("b", "01"): "saved"}
    assert spark.read.csv(out, header=True).count() == 3


def test_best_files_and_derived_columns(spark):
    units = spark.createDataFrame([("u", "f", "d", "55", "P1"), ("v", "f", "d", "66", "P2")], "unit string, recording_folder string, dyad_id string, sensor_id string, participant string")
    there = spark.createDataFrame([("f", "/s/f/55__P1.csv"), ("f", "/s/f/66.csv"), ("g", "/s/g/66.csv")], "recording_folder string, file string")
    assert {r.unit: r.file for r in files.best_file(units, there, "unit").collect()} == {"u": "/s/f/55__P1.csv", "v": "/s/f/66.csv"}
    raw = spark.createDataFrame([("60", "1.5"), ("x", "2.5")], "HR_BPM string, TimeUnix string")
    got = files.intervals_of(raw, rr=["rr_interval_ms"], hr=["HR_BPM"], t=["time"]).collect()
    assert [(r.rr_ms, r.hr_bpm, r.t) for r in got] == [(1000.0, 60.0, 1.5), (None, None, 2.5)]


def test_trials(spark):
    rng = np.random.default_rng(8)
    t = np.arange(300) / 4
    a = 70 + 5 * np.sin(2 * np.pi * 0.1 * t) + rng.normal(size=300)
    b = 72 + 5 * np.sin(2 * np.pi * 0.1 * t - 0.5) + rng.normal(size=300)
    rows = [("full", float(x), float(u), float(v)) for x, u, v in zip(t, a, b)] + [("few", float(i), 60.0, 61.0) for i in range(5)] + [("flat", float(i), 60.0, 61.0 + i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, t double, a double, b double")
    got = {r.k: r for r in trial.trial_metrics(df, ["k"], "t", fs=4.0, most_lag=20, width=30.0, step=15.0, seconds=0.25).collect()}
    full = got["full"]
    assert got["few"].status == "failed" and got["few"].error == "Too few valid paired samples: 5" and got["few"].mean_a is None and got["few"].leader is None
    assert got["flat"].status == "success" and got["flat"].kernel_error.startswith("ValueError") and got["flat"].pearson_r is None
    rest = [s - np.polyval(np.polyfit(t, s, 1), t) for s in (a, b)]
    assert full.pearson_r == pytest.approx(np.corrcoef(*rest)[0, 1]) and full.mean_phase == pytest.approx(0.5, abs=0.15)
    assert full.at_frequency == pytest.approx(0.1, abs=0.03) and full.pearson_p < 1e-6 and full.n_windows == 3
    assert full.sd1_a == pytest.approx(np.std(np.diff(60000 / a), ddof=1) / math.sqrt(2)) and full.leader in ("A", "B", "SYMMETRIC")
    rr = spark.createDataFrame([("s", i, 800.0 + 40 * math.sin(i / 2), 0.8 * i) for i in range(120)] + [("u", i, 800.0, 0.8 * i) for i in range(3)], "k string, i long, rr double, at double")
    hrv = {r.k: r for r in trial.variability(rr, ["k"], "i", "rr", "at").collect()}
    assert hrv["u"].status == "failed_too_few_rpeaks" and hrv["u"].mean_nn is None
    assert hrv["s"].status == "success" and hrv["s"].hf > 0 and hrv["s"].lf_hf == pytest.approx(hrv["s"].lf / hrv["s"].hf)


def test_order_of_levels(spark):
    df = spark.createDataFrame([("clean", 1), (None, 2), ("poor", 3), ("odd", 4), ("caution", 5)], "f string, i long")
    assert [r.f for r in trial.ordered(df, F.col("f"), ["clean", "caution", "poor"]).collect()] == ["clean", "caution", "poor", "odd", None]
    assert trial.ordered(df, F.col("f"), ["poor"], F.col("i"), most=2).count() == 2


def test_lags_by_sums(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 30))
    got = {r.lag: r.c for r in synchrony.cross_correlation(spark.createDataFrame([("k", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "k string, i long, a double, b double"), ["k"], "i", 40).collect()}
    x, y = a - a.mean(), b - b.mean()
    norm = math.sqrt((x * x).sum() * (y * y).sum())
    assert set(got) == set(range(-29, 30))
    assert all(got[n] == pytest.approx(sum(x[i + n] * y[i] for i in range(30) if 0 <= i + n < 30) / norm) for n in got)
