"""Scans in pieces against windows over whole keys and plain loops; a hot key is spread; matching in blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwave.operators import pairing, scan, series

SPANS = (1e9, 7.0, 1.0)


@pytest.fixture(scope="module")
def rows(spark):
    g = random.Random(4)
    made = [(None if g.random() < 0.1 else f"k{g.randrange(3)}", g.choice([None, *map(float, range(40))]), i, g.choice([None, 1.0, 2.5, 4.0])) for i in range(400)]
    return spark.createDataFrame(made, "k string, t double, i long, x double").repartition(7).cache()


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("span", SPANS)
def test_primitives_equal_whole_windows(rows, span):
    w = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_last(), "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    cut = scan.pieces(rows, ["k"], "t", span)
    # unknown times are last in a piece of their own, where nulls are equal
    order = ["t", "i"]
    for got, want in (
        (scan.running(cut, order, "v", F.col("i")), F.sum("i").over(upto)),
        (scan.beside(cut, order, {"v": "x"}), F.lag("x").over(w)),
        (scan.beside(cut, order, {"v": "x"}, ahead=True), F.lead("x").over(w)),
        (scan.known(cut, order, F.col("x"), "v"), F.last("x", True).over(upto)),
        (scan.known(cut, order, F.col("x"), "v", ahead=True), F.first("x", True).over(rest)),
    ):
        assert collected(got, "k", "i", "v") == collected(rows.withColumn("v", want), "k", "i", "v")


@pytest.mark.parametrize("span", SPANS)
def test_series_do_not_depend_on_pieces(rows, span):
    known = rows.where("t is not null")
    for f, columns in (
        (lambda s: series.numbered(rows, ["k"], "t", "i", span=s), ("k", "i", "n")),
        (lambda s: series.gap_groups(rows, ["k"], "t", 1.0, "i", span=s), ("k", "i", "group")),
        (lambda s: series.to_grid(known, ["k"], 0.75, tie="i", span=s), ("k", "k", "t", "x")),
        (lambda s: series.from_start(known, ["k"], 0.75, span=s), ("k", "i", "t", "x")),
        (lambda s: series.intervals(known.select("k", "t").distinct(), ["k"], span=s), ("k", "start", "end", "interval_number")),
        (lambda s: series.runs(known.dropDuplicates(["k", "t"]).select("k", "t"), ["k"], 1.0, 0.1, span=s), ("k", "t", "run", "pos")),
        (lambda s: series.filled(known.dropDuplicates(["k", "t"]), ["k"], "x", "t", "y", span=s), ("k", "t")),
    ):
        assert collected(f(span), *columns) == collected(f(1e12), *columns)


def test_runs_and_gaps_by_hand(spark):
    t = [0.0, 1.0, 2.0, 5.0, 6.0, 9.0]
    df = spark.createDataFrame([("k", x) for x in t], "k string, t double")
    for span in SPANS:
        got = sorted((r.t, r.run, r.pos) for r in series.runs(df, ["k"], 1.0, 0.01, span=span).collect())
        assert got == [(0.0, 1, 0), (1.0, 1, 1), (2.0, 1, 2), (5.0, 2, 0), (6.0, 2, 1), (9.0, 3, 0)]


def test_a_hot_key_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 500).alias("k"), F.col("id").cast("double").alias("t"), "id")
        most = {}
        for span in (None, 250.0):
            out = series.numbered(df, ["k"], "t", "id", span=span).where("n > 0")
            sizes = sorted(r["count"] for r in out.select(F.spark_partition_id().alias("p"), "n").groupBy("p").agg(F.count("n").alias("count"), F.max("n")).collect())
            most[span] = sizes[-1] / sizes[len(sizes) // 2]
        assert most[None] > 5 and most[250.0] < 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("size,reach", [(10, 3), (4, 9), (1000, 2)])
def test_overlapping_pieces_see_their_neighbours(spark, size, reach):
    df = spark.range(57).select(F.lit("k").alias("k"), F.col("id").alias("i"))
    cut = scan.overlapping(df, ["k"], "i", size, reach)
    got = cut.withColumn("s", F.sum("i").over(scan.within("i").rowsBetween(-reach, reach))).where("__own").orderBy("i").collect()
    assert [r.s for r in got] == [sum(range(max(0, i - reach), min(57, i + reach + 1))) for i in range(57)]


@pytest.mark.parametrize("block", [10**6, 300, 60, 5])
def test_one_to_one_is_the_serial_choice(spark, block):
    g = random.Random(2)
    rows = sorted({(left, left // 2 + g.randrange(-3, 4)) for left in range(150) for _ in range(4)})
    rows = [(a, b, float(g.randrange(5))) for a, b in rows]
    by, taken, want = {}, set(), {}
    for a, b, score in rows:
        by.setdefault(a, []).append((score, b))
    for a in sorted(by):
        free = [x for x in sorted(by[a]) if x[1] not in taken]
        want[a] = (free[0][1], False) if free else (min(by[a])[1], True)
        taken.add(want[a][0])
    got = pairing.greedy_one_to_one(spark.createDataFrame(rows, "left long, right long, score double"), block)
    assert {r.left: (r.right, r.shared) for r in got.collect()} == want
    assert np.mean([s for _, s in want.values()]) > 0.1


def test_sessions_without_candidates_are_told(spark):
    sessions = spark.createDataFrame([("a",), ("b",)], "session string")
    found = spark.createDataFrame([("a", 5, "later", 2.0), ("a", 4, "first", 1.0)], "session string, dyad long, kind string, score double")
    got = {r.session: (r.n_candidates, r.best, r.issue) for r in pairing.session_report(sessions, found).collect()}
    assert got == {"a": (2, "first", ""), "b": (0, None, "No candidate metadata row matched date/time/sensors.")}


@pytest.mark.parametrize("span", [100_000, 3])
def test_minutes_take_the_hour_of_their_anchor(spark, span):
    hour = 3600.0
    rows = [("a", 1, "59:30.5", "00:10"), ("a", 2, "bad", "00:10"), ("a", 40, "10:00", "09:00"), ("b", 1, "10:00", "11:00"), (None, 5, "30:00", "31:00"), ("a", 3, "61:00x", None)]
    anchors = [("a", 2, 10 * hour + 30), ("a", 3, 12 * hour + 900), ("a", 70, 20 * hour + 600), (None, 4, 5 * hour)]
    df = spark.createDataFrame(rows, "k string, i long, start_raw string, end_raw string")
    got = {(r.k, r.i): r for r in pairing.infer_windows(df, spark.createDataFrame(anchors, "k string, j long, at double"), ["k"], span=span).collect()}
    first = got["a", 1]
    assert (first.start, first.end, first.duration, first.j, first.in_reach) == (10 * hour - 29.5, 10 * hour + 10, 39.5, 2, True)
    assert first.score == min(59.5, 20) + 5
    # beyond reach the nearest place; an end before its start is an hour later
    late = got["a", 40]
    assert (late.j, late.in_reach, late.start, late.end, late.duration) == (70, False, 20 * hour + 600, 21 * hour + 540, 3540.0)
    assert all(got[k].start is None and got[k].j is None for k in (("a", 2), ("b", 1), ("a", 3)))
    # half an hour either way: the earlier hour
    assert got[None, 5].start == 5 * hour - 1800 and got[None, 5].end == 5 * hour - 1740


def test_minutes_on_a_known_hour(spark):
    from pairwave.functions import text

    df = spark.createDataFrame([("05:30.25", "2024-07-01", 9), ("x", "2024-07-01", 9), ("05:30", "2024-01-01", 23)], "c string, day string, hour int")
    got = [r.at for r in df.select(text.minute_at(F.col("c"), F.col("day"), F.col("hour"), "America/Vancouver").alias("at")).collect()]
    assert got == [1719849930.25, None, 1704179130.0]
