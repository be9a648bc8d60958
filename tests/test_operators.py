"""Edge cases of the time-series operators on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwave.functions import stats, text
from pairwave.operators import mixed, pairing, series, signal, summary, synchrony, transfer
from pairwave.sources import files
from pairwave.streaming import live


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_a_gap_of_exactly_the_limit_joins(spark):
    df = frame(spark, [("s", 0.0, 1), ("s", 1200.0, 2), ("s", 2400.1, 3), ("s", None, 4), ("s", None, 5)], "k string, t double, i long")
    got = [r.group for r in series.gap_groups(df, ["k"], "t", 1200.0, "i").orderBy("i").collect()]
    assert got == [1, 1, 2, 3, 4]


def test_grid_and_interpolation(spark):
    df = frame(spark, [("s", 0.1, 10.0), ("s", 0.6, 20.0), ("s", 0.6, 99.0), ("s", 1.0, 0.0), ("u", 0.5, 7.0)], "k string, t double, x double")
    got = sorted((r.k0, r.t, round(r.x, 9)) for r in series.to_grid(df.withColumnRenamed("k", "k0"), ["k0"], 0.25).collect())
    assert got == [("s", 0.25, 13.0), ("s", 0.5, 18.0), ("s", 0.75, 12.5), ("s", 1.0, 0.0), ("u", 0.5, 7.0)]


def test_short_and_thin_windows(spark):
    rows = [("short", float(i), float(i), float(i % 7)) for i in range(25)] + [("thin", float(2 * i), float(i), float(i % 5)) for i in range(40)]
    got = synchrony.windowed(frame(spark, rows, "k string, t double, a double, b double"), ["k"], 30.0, 15.0).collect()
    assert [(r.window_index, r.n) for r in got if r.k == "short"] == [(0, 25)]
    assert not [r for r in got if r.k == "thin"]


def test_constant_series_have_no_r(spark):
    df = frame(spark, [(1.0, float(i)) for i in range(30)], "a double, b double")
    assert df.agg(stats.pearson(F.col("a"), F.col("b")).alias("r")).first().r is None


def test_runs_split_at_missing_samples(spark):
    df = frame(spark, [("s", i * 0.25) for i in range(20) if i != 9], "k string, t double")
    got = series.count_windows(series.runs(df, ["k"], 0.25, 0.02), ["k"], 4, 2).groupBy("run", "window").count().collect()
    assert sorted((r.run, r.window, r["count"]) for r in got) == [(1, 0, 4), (1, 1, 4), (1, 2, 4), *[(2, i, 4) for i in range(4)]]


@pytest.mark.parametrize(("n", "status", "pairs"), [(19, "too_few_pairs", 9), (20, "success", 10), (21, "success", 10)])
def test_odd_even_pairs(spark, n, status, pairs):
    df = frame(spark, [("s", i, 800.0 + (i * 37) % 50) for i in range(n)], "k string, i long, rr double")
    r = summary.odd_even(df, ["k"], "rr", "i").first()
    assert (r.status, r.n_pairs) == (status, pairs)


def test_identifiers_and_times(spark):
    raw = ["2.5143E+11", "251430002238.0", " ", "nan", "A7"]
    df = frame(spark, [(x,) for x in raw], "x string")
    assert [r[0] for r in df.select(text.identifier(F.col("x"))).collect()] == ["251430000000", "251430002238", "", "", "A7"]
    one = frame(spark, [("59:30.0", 3600.0 * 5 + 60)], "m string, t double").select(text.minute_near(F.col("m"), F.col("t")).alias("x")).first()
    assert one.x == 3600.0 * 4 + 59 * 60 + 30


def test_dyad_flags(spark):
    df = frame(spark, [("q", "clean"), ("q", None), ("p", "poor"), ("p", "clean")], "d string, f string")
    got = {r.d: (r.a, r.b) for r in df.groupBy("d").agg(summary.dyad_flag(F.col("f")).alias("a"), summary.dyad_flag(F.col("f"), strict=True).alias("b")).collect()}
    assert got == {"q": ("both_clean", "incomplete"), "p": ("poor", "poor")}


def test_greedy_matching(spark):
    df = frame(spark, [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 0.5), (3, 1, 9.0)], "left long, right long, score double")
    got = sorted((r.left, r.right, r.shared) for r in pairing.greedy_one_to_one(df).collect())
    assert got == [(1, 1, False), (2, 1, True), (3, 1, True)]


def test_symbols_break_ties_in_order(spark):
    df = frame(spark, [("s", i, x, x) for i, x in enumerate([2.0, 2.0, 1.0, 3.0])], "k string, i long, a double, b double")
    assert [r.sa for r in transfer.symbols(df, ["k"], "i").orderBy("pos").collect()] == [231, 213]
    assert transfer.np_symbols(np.array([2.0, 2.0, 1.0, 3.0]), 3, 1).tolist() == [3, 2]


def test_surrogates_find_a_copied_series(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=240)
    rows = [("led", i, float(a[i]), float(a[i - 1] if i else 0.0)) for i in range(240)] + [("free", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(240, 2)))]
    df = frame(spark, [*rows, ("flat", 1, 1.0, 2.0), ("flat", 2, 1.0, 3.0)], "k string, i long, a double, b double")
    got = {(r.k, r.tau): r for r in transfer.surrogate_tests(df, ["k"], "i", taus=[1, 2], surrogates=60, shuffles=5, chunk=25).collect()}
    assert set(got) == {(k, t) for k in ("led", "free") for t in (1, 2)}
    led, free = got["led", 1], got["free", 1]
    assert led.nste_ab_p == pytest.approx(1 / 61) and led.nste_ab > free.nste_ab and led.nste_asymmetry_p == pytest.approx(1 / 61)
    assert led.nste_asymmetry == pytest.approx(led.nste_ba - led.nste_ab) and led.n_symbols == 240 - 2 - led.delta and not led.few_symbols


def test_kernels():
    t = np.arange(512) / 4
    a, b = np.sin(2 * np.pi * 0.1 * t), np.sin(2 * np.pi * 0.1 * t - 0.7)
    p = signal.phases(a + 0.01 * t, b)
    assert p["plv"] > 0.95 and abs(p["mean_phase"] - 0.7) < 0.1
    with pytest.raises(ValueError):
        signal.phases(t, a)
    noise = np.random.default_rng(0).normal(size=(2, 512))
    assert signal.coherence(a + noise[0] * 0.1, b + noise[1] * 0.1, 4.0)["at_frequency"] == pytest.approx(0.1, abs=0.03)
    assert signal.t_test_p(0.5, 20) == pytest.approx(0.02478, abs=1e-4)
    lead = np.random.default_rng(1).normal(size=200)
    assert signal.granger(lead, np.concatenate(([0.0], lead[:-1])) + 0.1 * noise[0][:200])["direction"] in ("A", "both")
    rng = np.random.default_rng(2)
    g, x = np.repeat(np.arange(20), 8), rng.normal(size=160)
    assert signal.t_test_p(1.0, 3) == 0.0 and np.isnan(signal.t_test_p(0.5, 2)) and g.max() == 19 and len(x) == 160


def test_sources_and_sinks(spark, tmp_path):
    at = tmp_path / "2024_01_02-03_04_05" / "77"
    at.mkdir(parents=True)
    (at / "ECG.csv").write_text("Sensor 77 at 128\nTimestamp,Sample\n1.5,2\nbad,3\n2.5,4\n")
    (at / "._ECG.csv").write_text("x")
    got = files.sensor_csv(spark, str(at / "ECG.csv")).orderBy("place").collect()
    assert [(r.Timestamp, r.Sample) for r in got] == [(1.5, 2.0), (2.5, 4.0)]
    assert files.titles(spark, str(at / "ECG.csv")).first().title == "Sensor 77 at 128"
    assert [(r.session, r.sensor, r.kind) for r in files.inventory(spark, str(tmp_path)).collect()] == [("2024_01_02-03_04_05", "77", "ECG")]
    (tmp_path / "t.csv").write_text(" id ,v,note\n12.0,x,a\n13,2.5,b\n")
    table = files.table_csv(spark, str(tmp_path / "t.csv"), ["id"], ["v"], ["id"])
    assert [tuple(r) for r in table.collect()] == [("12", None, "a"), ("13", 2.5, "b")]
    with pytest.raises(ValueError):
        files.table_csv(spark, str(tmp_path / "t.csv"), [], [], ["absent"])
    none = files.optional(lambda: spark.read.parquet(str(tmp_path / "none")), T.StructType([T.StructField("a", T.LongType())]), spark)
    assert none.columns == ["a"] and none.count() == 0
    assert files.resolve(table, ["NOTE"]) == "note" and files.resolve(table, ["ot"], within=True) == "note" and files.resolve(table, ["q"]) is None
    files.write_csv(table, str(tmp_path / "out"), ["id"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    assert sorted(tuple(r) for r in files.run_summary(table, ["note"]).collect()) == [("note", "a", 1), ("note", "b", 1)]
    (tmp_path / "metadata.json").write_text('{"participant_1": "a",\n "sampling_rate_p1": 128}')
    assert files.metadata_json(spark, str(tmp_path / "metadata.json")).first().sampling_rate_p1 == 128.0
    units = frame(spark, [("f", 1, 2, " 5 ", "6", 7.0, "", "P2", 1.0, 60.0, -1.0)], "recording_folder string, candidate_window long, trial long, sensor_A string, sensor_B string, x double, participant_A string, participant_B string, TimeUnix double, HR_A_BPM double, HR_B_BPM double")
    assert files.sensor_manifest(units).count() == 2
    assert [tuple(r) for r in files.long_form(units).collect()] == [(" 5 ", "f__1__2", 1.0, 60.0)]
    score = units.select(files.file_score(F.lit("/x/f/6.csv"), F.col("recording_folder"), F.lit("d"), F.col("sensor_B"), F.lit("")).alias("s"))
    assert score.first().s == 10


def test_live_sessions(spark, tmp_path):
    rows = [("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:10:00"), ("k", "2024-01-01 02:00:00"), ("k", "2024-01-03 00:00:00")]
    frame(spark, rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("t"), F.lit(1.0).alias("x")).write.parquet(str(tmp_path / "in"))
    for name, made in (("gaps", live.live_gap_groups), ("sums", lambda s, k, t: live.live_window_summary(s, k, t, "x"))):
        stream = made(spark.readStream.schema("k string, t timestamp, x double").parquet(str(tmp_path / "in")), ["k"], "t")
        run = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert sorted(r.n for r in spark.table("gaps").collect()) == [1, 2]
    assert spark.table("sums").count() >= 3
