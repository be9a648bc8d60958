"""ECG, spectra, Granger and recurrence by parts against plain loops over whole series; parts of any length agree."""

import numpy as np
import pytest

from pairwave.operators import dependence, ecg, series, signal, spectra
from pairwave.operators.storage import cut

FS = 64.0


def moving(x, size):
    low, high = size // 2, size - 1 - size // 2
    return np.array([x[max(0, i - low) : i + high + 1].mean() for i in range(len(x))])


def plain_peaks(x):
    drift, hum, short, long = 2 * round(FS) + 1, max(1, round(FS / 50)), max(1, int(0.1 * FS)), max(1, int(0.75 * FS))
    c = np.round(moving(x - moving(x, drift), hum), 9)
    steep = np.abs(np.gradient(c))
    edge = np.diff(np.concatenate(([0], (moving(steep, short) > 1.5 * moving(steep, long)).astype(int), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes, out = ends - begins, []
    for a, b in zip(begins, ends):
        if b - a < 0.4 * sizes.mean():
            continue
        p = a + int(np.argmax(c[a:b]))
        if not out or p - out[-1] > 0.3 * FS:
            out.append(p)
        elif c[p] > c[out[-1]]:
            out[-1] = p
    return [int(p) for p in out]


def plain_fix(peaks, fs, rounds=5):
    peaks, told = np.unique(peaks), {"extra": 0, "missed": 0, "shifted": 0}
    for _ in range(rounds):
        rr = np.diff(peaks) / fs
        if len(peaks) < 3:
            break
        around = np.array([np.median(rr[max(0, i - 5) : i + 6]) for i in range(len(rr))])
        jump = np.abs(np.diff(rr, prepend=rr[0]))
        limit = np.maximum([2.6 * np.subtract(*np.percentile(jump[max(0, i - 45) : i + 46], [75, 25])) for i in range(len(rr))], 0.15 * around)
        drop, add, move, skip = [], [], [], -1
        for i in range(len(rr)):
            more = i + 1 < len(rr)
            if i <= skip:
                continue
            if more and around[i] - rr[i] > limit[i] and abs(rr[i] + rr[i + 1] - around[i]) < limit[i]:
                drop.append(i + 1)
                skip = i + 1
            elif more and (rr[i] - around[i]) * (rr[i + 1] - around[i]) < 0 and min(abs(rr[i] - around[i]), abs(rr[i + 1] - around[i])) > limit[i] and abs(rr[i] + rr[i + 1] - 2 * around[i]) < limit[i]:
                move.append(i + 1)
                skip = i + 1
            elif rr[i] - around[i] > limit[i] and abs(rr[i] / 2 - around[i]) < limit[i]:
                add.append((peaks[i] + peaks[i + 1]) // 2)
        if not drop + add + move:
            break
        for k, x in (("extra", drop), ("missed", add), ("shifted", move)):
            told[k] += len(x)
        for i in move:
            peaks[i] = (peaks[i - 1] + peaks[i + 1]) // 2
        peaks = np.unique(np.concatenate((np.delete(peaks, drop), np.array(add, int))))
    return [int(p) for p in peaks], told


@pytest.fixture(scope="module")
def heart():
    rng = np.random.default_rng(1)
    beats = np.cumsum(rng.normal(0.85, 0.05, 90))
    beats = np.sort(np.concatenate((np.delete(beats, [30, 31, 60]), [beats[50] + 0.35])))
    beats[70] += 0.3
    t = np.arange(0, beats[-1] + 1, 1 / FS)
    return t, sum(np.exp(-0.5 * ((t - b) / 0.02) ** 2) for b in beats) + 0.3 * np.sin(0.4 * np.pi * t) + rng.normal(0, 0.02, len(t)), beats


@pytest.mark.parametrize("size", [65_536, 500])
def test_peaks_do_not_depend_on_pieces(spark, heart, size):
    t, x, beats = heart
    rows = [("s", float(a), float(b)) for a, b in zip(t, x)] + [("flat", float(a), 1.0) for a in t[:50]] + [("s", 9e9, None)]
    placed = cut(ecg.placed(spark.createDataFrame(rows, "k string, t double, x double").repartition(5), ["k"], span=size / FS))
    raw = cut(ecg.peaks(ecg.complexes(ecg.steepness(placed, ["k"], FS, size), ["k"], size), ["k"], FS, size))
    got = sorted(r.place for r in raw.where("k = 's'").collect())
    assert got == plain_peaks(x) and raw.where("k = 'flat'").count() == 0
    near = [min(abs(p / FS - b) for p in got) for b in beats]
    assert np.mean(np.array(near) < 0.03) > 0.97
    fixed, told = ecg.corrected(raw, ["k"], FS, size=max(20, size // 20))
    want, counts = plain_fix(np.array(got), FS)
    assert sorted(r.place for r in fixed.collect()) == want
    assert {k: told.first()[k] for k in counts} == counts and sum(counts.values()) > 2


def test_corrections_by_kind(spark):
    beats = np.arange(0, 60 * 100, 100)
    moved = beats.copy()
    moved[30] += 35
    made = {"same": beats, "missed": np.delete(beats, 20), "extra": np.sort(np.append(beats, 2040)), "shifted": moved, "few": beats[:2]}
    rows = [(k, int(p)) for k, x in made.items() for p in x]
    fixed, told = ecg.corrected(spark.createDataFrame(rows, "k string, place long"), ["k"], 128.0)
    got = {k: sorted(r.place for r in fixed.where(f"k = '{k}'").collect()) for k in made}
    assert all(got[k] == beats.tolist() for k in made if k != "few") and got["few"] == [0, 100]
    assert {r.k: (r.extra, r.missed, r.shifted) for r in told.collect()} == {"missed": (0, 1, 0), "extra": (1, 0, 0), "shifted": (0, 0, 1)}


def test_a_recording_s_row_and_intervals(spark, heart):
    t, x, _ = heart
    df = spark.createDataFrame([("s", 100.0 + float(a), float(b)) for a, b in zip(t, x)], "k string, t double, x double")
    fixed, told = ecg.recordings(df, ["k"], FS)
    row = told.first()
    assert row["samples"] == len(t) and row["first"] == 100.0 and row["n_fixed"] == fixed.count() and row["gain_db"] > 0
    rr = ecg.intervals(fixed, told, ["k"], FS).orderBy("interval_number").collect()
    assert len(rr) == row["n_fixed"] - 1 and rr[0]["start"] == 100.0 + min(r.place for r in fixed.collect()) / FS
    assert all(r.plausible == (300 <= r.rr_ms <= 2000) and r.extreme == (not 40 <= r.hr_bpm <= 200) for r in rr)


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(5)
    a = np.cumsum(rng.normal(size=700))
    b = np.concatenate((np.zeros(3), 0.5 * a[:-3])) + rng.normal(size=700)
    rows = [("k", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))] + [("flat", i, 1.0, float(a[i])) for i in range(300)] + [("few", i, float(a[i]), float(b[i])) for i in range(12)]
    return a, b, spark.createDataFrame(rows, "k string, i long, a double, b double").repartition(6).cache()


def test_coherence_by_segments(pair):
    a, b, df = pair
    got = {r.k: r for r in spectra.coherence(df, ["k"], "i", 4.0).collect()}
    want = signal.coherence(a, b, 4.0)
    assert all(got["k"][c] == pytest.approx(want[c], rel=1e-9) for c in want)
    assert got["few"].n == 12 and got["few"].mean_coherence is None and got["flat"].mean_coherence is None


def test_band_powers_by_segments(spark):
    rng = np.random.default_rng(8)
    rr = 800 + 40 * np.sin(np.arange(900) / 2) + rng.normal(0, 5, 900)
    t = np.cumsum(rr) / 1000
    df = spark.createDataFrame([("s", float(x), float(y)) for x, y in zip(t, rr)] + [("few", 0.0, 800.0), ("few", 0.8, 810.0)], "k string, t double, rr double")
    grid = np.arange(t[0], t[-1], 0.25)
    x = signal.line_removed(np.interp(grid, t, rr))
    f, p = signal.welch(x, x, 4.0, 256)

    def area(low, high):
        inside = (f >= low) & (f < high)
        return float(((p.real[inside][1:] + p.real[inside][:-1]) / 2 * np.diff(f[inside])).sum())

    for span in (1e9, 30.0):
        got = {r.k: r for r in spectra.band_powers(df, ["k"], "t", "rr", span=span).collect()}
        assert got["s"].n == len(grid) and got["s"].lf == pytest.approx(area(0.04, 0.15)) and got["s"].hf == pytest.approx(area(0.15, 0.40))
        assert got["few"].n == 4 and got["few"].lf is None


@pytest.mark.parametrize("size", [65_536, 50])
def test_granger_by_sums(pair, size):
    a, b, df = pair
    got = {r.k: r for r in dependence.granger(df, ["k"], "i", size=size).collect()}
    want = signal.granger(a, b)
    assert got["k"].p_ab == pytest.approx(want["p_ab"], abs=1e-9) and got["k"].p_ba == pytest.approx(want["p_ba"], abs=1e-9)
    assert got["k"].direction == want["direction"] and got["few"].direction == "unavailable"
    assert got["flat"].error == "a constant series" and got["flat"].p_ab is None


@pytest.mark.parametrize("dim,delay,radius", [(3, 1, 0.1), (2, 3, 0.3), (1, 1, 0.05)])
def test_recurrence_by_cells(pair, dim, delay, radius):
    a, b, df = pair
    got = {r.k: r for r in dependence.cross_recurrence(df, ["k"], "i", dim, delay, radius).collect()}
    want = signal.cross_recurrence(a, b, dim, delay, radius)
    assert all(got["k"][c] == pytest.approx(want[c]) for c in want)
    assert got["few"].rr is None and got["flat"].error == "a constant series"


def test_grid_from_the_first_time(spark):
    df = spark.createDataFrame([("k", 0.3, 1.0), ("k", 0.3, 9.0), ("k", 1.3, 3.0), ("k", 1.8, 2.0), ("one", 1.0, 1.0)], "k string, t double, x double")
    got = [(r.i, round(r.t, 9), round(r.x, 9)) for r in series.from_start(df, ["k"], 0.5).orderBy("i").collect()]
    assert got == [(0, 0.3, 1.0), (1, 0.8, 2.0), (2, 1.3, 3.0)]
