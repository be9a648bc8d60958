"""ECG to R peaks by windows over samples, in overlapping pieces: a recording of any length is no single task.

Filters have a finite length, so a sample's result needs only the samples around it. Each piece of a recording is given its
neighbours' edges, and keeps the results of its own samples only; so nothing depends on how long pieces are. Steps: a moving
mean of two seconds is taken off (drift), a short one smooths (mains hum); where the mean steepness of a tenth of a second
exceeds that of three quarters of a second by half, a QRS complex is suspected; its peak is its highest sample. Intervals
between peaks are corrected by limits that follow their medians and the spread of their changes: a beat too many goes, a
missed one is put in, one between a long and a short interval is put half-way.

Recordings are rows of keys, i (counted from 0 in order, see ``placed``) and x. Nulls of x are left out by ``placed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import scan, series
from .storage import cut

#: Samples and beats of a piece.
SAMPLES, BEATS = 65_536, 4096


def placed(samples: DataFrame, keys: list[str], t: str = "t", x: str = "x", span: float = 3600.0) -> DataFrame:
    """keys, i, t, x of samples with a time and a value; the time of a peak is the first time plus its place over the rate."""
    rows = samples.where(F.col(t).isNotNull() & F.col(x).isNotNull()).select(*keys, F.col(t).alias("t"), F.col(x).cast("double").alias("x"))
    # written, as the scan reads them twice
    out = scan.running(scan.pieces(cut(rows), keys, "t", span), ["t", "x"], "i", F.lit(1))
    return out.select(*keys, (F.col("i") - 1).alias("i"), "t", "x")


def _around(w: WindowSpec, size: int) -> WindowSpec:
    return w.rowsBetween(-(size // 2), size - 1 - size // 2)


def steepness(rows: DataFrame, keys: list[str], fs: float, size: int = SAMPLES) -> DataFrame:
    """keys, i, x, clean, inside (of a steep stretch) and begins (one) of each sample."""
    drift, hum = 2 * round(fs) + 1, max(1, round(fs / 50))
    short, long = max(1, int(0.1 * fs)), max(1, int(0.75 * fs))
    reach = drift + hum + 2 + long
    w = scan.within("i")
    out = scan.overlapping(rows.select(*keys, "i", "x"), keys, "i", size, reach)
    out = out.withColumn("clean", F.col("x") - F.avg("x").over(_around(w, drift)))
    # to nine digits, so that equal heights are equal whatever the order of their sums
    out = out.withColumn("clean", F.round(F.avg("clean").over(_around(w, hum)), 9))
    before, after = F.lag("clean").over(w), F.lead("clean").over(w)
    two = F.when(before.isNotNull() & after.isNotNull(), 2.0).otherwise(1.0)
    out = out.withColumn("steep", F.abs(F.coalesce(after, "clean") - F.coalesce(before, "clean")) / two)
    out = out.withColumn("inside", F.avg("steep").over(_around(w, short)) > 1.5 * F.avg("steep").over(_around(w, long)))
    out = out.withColumn("begins", F.col("inside") & ~F.coalesce(F.lag("inside").over(w), F.lit(False)))
    return out.where("__own").select(*keys, "i", "x", "clean", "inside", "begins")


def complexes(steep: DataFrame, keys: list[str], span: int = SAMPLES) -> DataFrame:
    """keys, begin, n (samples), place and height of the highest sample of each steep stretch."""
    # written, as the scan reads it twice
    inside = scan.pieces(cut(steep.where("inside").select(*keys, "i", "clean", "begins")), keys, "i", span)
    inside = scan.known(inside, ["i"], F.when(F.col("begins"), F.col("i")), "begin")
    top = F.max(F.struct("clean", (-F.col("i")).alias("back")))
    out = inside.groupBy(*keys, "begin").agg(F.count("*").alias("n"), top.alias("top"))
    return out.select(*keys, "begin", "n", (-F.col("top.back")).alias("place"), F.col("top.clean").alias("height"))


def peaks(stretches: DataFrame, keys: list[str], fs: float, span: int = SAMPLES) -> DataFrame:
    """keys, place, height: of stretches not much shorter than the recording's mean, the highest within 0.3 seconds.

    Peaks further apart don't meet; those that follow each other more closely are gone through in order, and each either
    takes the place of the last one, if it is higher, or goes.
    """
    name, stretches = F.struct(*keys), cut(stretches)
    means = stretches.groupBy(name.alias("__key")).agg((0.4 * F.avg("n")).alias("least"))
    rows = stretches.withColumn("__key", name).join(means, "__key").where("n >= least").select(*keys, "place", "height")
    close = series.gap_groups(rows, keys, "place", 0.3 * fs, "place", span)
    lists = close.groupBy(*keys, "group").agg(F.sort_array(F.collect_list(F.struct("place", "height"))).alias("found"))

    def choose(kept: Column, x: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        far = F.size(kept).eqNullSafe(0) | (x["place"] - last["place"] > 0.3 * fs)
        return F.when(far, F.concat(kept, F.array(x))).when(x["height"] > last["height"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))).otherwise(kept)

    kept = F.aggregate("found", F.array().cast("array<struct<place:bigint,height:double>>"), choose)
    return lists.select(*keys, F.explode(kept).alias("x")).select(*keys, "x.place", "x.height")


def _judged(places: DataFrame, keys: list[str], fs: float, size: int) -> DataFrame:
    """keys, n, place, next, moved (where the next peak would be half-way), drop, move, add, follows of each peak."""
    numbered = scan.running(scan.pieces(places.select(*keys, "place"), keys, "place", SAMPLES), ["place"], "n", F.lit(1)).drop(scan.PIECE)
    rows = scan.overlapping(numbered, keys, "n", size, 60)
    w = scan.within("n")
    rows = rows.withColumn("next", F.lead("place").over(w)).withColumn("rr", (F.col("next") - F.col("place")) / fs)
    rows = rows.withColumn("jump", F.when(F.col("rr").isNotNull(), F.coalesce(F.abs(F.col("rr") - F.lag("rr").over(w)), F.lit(0.0))))
    near, wide = w.rowsBetween(-5, 5), w.rowsBetween(-45, 45)
    rows = rows.withColumn("around", F.percentile("rr", F.lit(0.5)).over(near)).withColumn("after", F.lead("rr").over(w))
    spread = F.percentile("jump", F.lit(0.75)).over(wide) - F.percentile("jump", F.lit(0.25)).over(wide)
    rows = rows.withColumn("limit", F.greatest(2.6 * spread, 0.15 * F.col("around")))
    rr, after, around, limit = (F.col(c) for c in ("rr", "after", "around", "limit"))
    no = lambda c: F.coalesce(c, F.lit(False))
    drop = no((around - rr > limit) & (F.abs(rr + after - around) < limit))
    off, off_after = rr - around, after - around
    move = no((off * off_after < 0) & (F.least(F.abs(off), F.abs(off_after)) > limit) & (F.abs(off + off_after) < limit))
    add = no((off > limit) & (F.abs(rr / 2 - around) < limit))
    rows = rows.withColumn("drop", drop).withColumn("move", move & ~F.col("drop")).withColumn("add", add & ~F.col("drop") & ~F.col("move"))
    rows = rows.withColumn("moved", F.floor((F.col("place") + F.lead("place", 2).over(w)) / 2))
    rows = rows.withColumn("follows", no(F.lag(F.col("drop") | F.col("move")).over(w)))
    return rows.where("__own").select(*keys, "n", "place", "next", "moved", "drop", "move", "add", "follows")


def _corrected_once(places: DataFrame, keys: list[str], fs: float, size: int) -> DataFrame:
    """keys, place, and extra, missed, shifted: how many of each kind a peak stands for."""
    rows = scan.pieces(cut(_judged(places, keys, fs, size)), keys, "n", size)
    # of intervals in a row that call for a change, which takes the next one too, every second one is changed
    first = F.when((F.col("drop") | F.col("move")) & ~F.col("follows"), F.col("n"))
    rows = scan.known(rows, ["n"], first, "__first")
    done = (F.col("drop") | F.col("move")) & ((F.col("n") - F.col("__first")) % 2 == 0)
    rows = rows.withColumn("drop", F.col("drop") & done).withColumn("move", F.col("move") & done)
    rows = scan.beside(rows, ["n"], {"__drop": "drop", "__move": "move", "__to": "moved"})
    gone, moved = F.coalesce("__drop", F.lit(False)), F.coalesce("__move", F.lit(False))
    kept = F.when(~gone, F.struct(F.when(moved, F.col("__to")).otherwise(F.col("place")).alias("place"), F.lit(0).alias("missed"), F.when(moved, 1).otherwise(0).alias("shifted")))
    put_in = F.when(F.col("add") & ~gone & ~moved, F.struct(F.floor((F.col("place") + F.col("next")) / 2).alias("place"), F.lit(1).alias("missed"), F.lit(0).alias("shifted")))
    rows = rows.withColumn("extra", F.when(gone, 1).otherwise(0)).withColumn("x", F.array_compact(F.array(kept, put_in)))
    # a peak that goes is told of by a row without a place
    none = F.array(F.struct(F.lit(None).cast("long").alias("place"), F.lit(0).alias("missed"), F.lit(0).alias("shifted")))
    out = rows.select(*keys, "extra", F.explode(F.when(F.size("x") > 0, F.col("x")).otherwise(none)).alias("x"))
    return out.groupBy(*keys, "x.place").agg(*[F.sum(c).alias(c.rpartition(".")[2]) for c in ("extra", "x.missed", "x.shifted")])


def corrected(places: DataFrame, keys: list[str], fs: float, rounds: int = 5, size: int = BEATS) -> tuple[DataFrame, DataFrame]:
    """Peaks (keys, place) after at most rounds corrections, and keys, extra, missed, shifted of recordings with any."""
    now, told = places.select(*keys, "place").distinct(), []
    for _ in range(rounds):
        made = cut(_corrected_once(now, keys, fs, size))
        counts = made.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("extra", "missed", "shifted")]).where("extra + missed + shifted > 0")
        now = made.where("place is not null").select(*keys, "place")
        told.append(counts)
        if counts.isEmpty():
            break
    whole = told[0]
    for more in told[1:]:
        whole = whole.unionByName(more)
    return now, whole.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("extra", "missed", "shifted")])


def intervals(places: DataFrame, starts: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Intervals between peaks with the reference's limits: series.intervals and plausible (300 to 2000 ms), extreme (HR).

    starts: keys, first (the time of the first sample).
    """
    name = F.struct(*keys)
    timed = places.withColumn("__key", name).join(starts.select(name.alias("__key"), "first"), "__key").drop("__key")
    rr = series.intervals(timed.select(*keys, (F.col("first") + F.col("place") / fs).alias("t")), keys)
    return rr.withColumn("plausible", F.col("rr_ms").between(300, 2000)).withColumn("extreme", ~F.col("hr_bpm").between(40, 200))


def recordings(samples: DataFrame, keys: list[str], fs: float, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Corrected peaks (keys, place) of samples (keys, t, x), and a row a recording: keys, first, samples, n_raw, n_fixed,
    extra, missed, shifted, gain_db (of the raw signal's SD over the cleaned one's)."""
    rows = cut(placed(samples, keys))
    steep = cut(steepness(rows, keys, fs))
    raw = cut(peaks(complexes(steep, keys), keys, fs))
    fixed, counts = corrected(raw, keys, fs)
    gain = 20 * F.log10(F.stddev_pop("x") / F.nullif(F.stddev_pop("clean"), F.lit(0.0)))
    each = steep.groupBy(*keys).agg(F.count("*").alias("samples"), gain.alias("gain_db"))
    named = lambda df: df.select(F.struct(*keys).alias("__key"), *[c for c in df.columns if c not in keys])
    out = each.withColumn("__key", F.struct(*keys)).join(named(rows.groupBy(*keys).agg(F.min("t").alias("first"))), "__key")
    for df in (raw.groupBy(*keys).agg(F.count("*").alias("n_raw")), fixed.groupBy(*keys).agg(F.count("*").alias("n_fixed")), counts):
        out = out.join(named(df), "__key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_raw", "n_fixed", "extra", "missed", "shifted")]
    return fixed, out.select(*keys, "first", "samples", *zero, "gain_db")
