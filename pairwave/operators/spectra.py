"""Welch spectra by segments: each segment is a row of its own, and spectra are sums over segments by frequency.

A series of any length is cut into segments of at most SEGMENT samples, half overlapping; a segment's samples are gathered
into one row, so no group is longer than a segment. Segments are transformed a batch at a time (NumPy's FFT in a vectorised
function); powers and cross-powers are then averaged by key and frequency, combined before their shuffle. Hann window, each
segment's mean removed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import series
from .storage import cut

SEGMENT = 256


def named(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with __key, all keys as one that is never null, and without them."""
    return df.select(F.struct(*keys).alias("__key"), *[c for c in df.columns if c not in keys])


def unnamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col("__key")[k].alias(k) for k in keys], *[c for c in df.columns if c != "__key"])


#: What a transformed segment has, an array over its frequencies each.
POWERS = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("aa", "bb", "re", "im")])


@F.pandas_udf(POWERS)
def transformed(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Powers of a and b and the real and imaginary part of their cross-power, of each segment at its frequencies."""
    out = {c: np.empty(len(a), object) for c in ("aa", "bb", "re", "im")}
    sizes = a.map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        u, v = (np.stack(x.to_numpy()[at]) for x in (a, b))
        u, v = (np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1) for x in (u, v))
        cross = np.conj(u) * v
        for c, x in (("aa", abs(u) ** 2), ("bb", abs(v) ** 2), ("re", cross.real), ("im", cross.imag)):
            out[c][at] = list(x)
    return pd.DataFrame(out)


def spectra(rows: DataFrame, fs: float) -> DataFrame:
    """__key, size, q, f and the means aa, bb, re, im over segments; rows: __key, i (from 0), a, b, n (samples of the key), size."""
    step = F.greatest(F.col("size") - F.floor(F.col("size") / 2), F.lit(1))
    low = F.greatest(F.ceil((F.col("i") - F.col("size") + 1) / step), F.lit(0))
    high = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - F.col("size")) / step))
    dealt = rows.withColumn("__low", low).withColumn("__high", high).where("__low <= __high")
    dealt = dealt.withColumn("segment", F.explode(F.sequence("__low", "__high")))
    whole = dealt.groupBy("__key", "size", "segment").agg(F.sort_array(F.collect_list(F.struct("i", "a", "b"))).alias("x"))
    made = whole.select("__key", "size", transformed(F.col("x")["a"], F.col("x")["b"]).alias("s"))
    each = made.select("__key", "size", F.posexplode(F.arrays_zip("s.aa", "s.bb", "s.re", "s.im")).alias("q", "p"))
    out = each.groupBy("__key", "size", "q").agg(*[F.avg(F.col("p")[c]).alias(c) for c in ("aa", "bb", "re", "im")])
    return out.withColumn("f", F.col("q") * F.lit(float(fs)) / F.col("size"))


def coherence(pairs: DataFrame, keys: list[str], order: str, fs: float, low: float = 0.04, high: float = 0.40, least: int = SEGMENT, span: float | None = None) -> DataFrame:
    """keys, n, and the mean, the largest and the place of the largest magnitude-squared coherence of a and b within a band.

    Segments are a quarter of the series at most; a series of fewer than least samples has none. span: of the order column,
    cuts long series where they are numbered.
    """
    rows = series.numbered(pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()), keys, order, name="i", span=span)
    rows = named(rows.select(*keys, (F.col("i") - 1).alias("i"), "a", "b"), keys)
    sizes = rows.groupBy("__key").agg(F.count("*").alias("n"))
    size = F.least(F.lit(SEGMENT), F.floor(F.col("n") / 4)).cast("long")
    usable = sizes.withColumn("size", size).where((F.col("n") >= least) & (F.col("size") >= 16))
    s = spectra(rows.join(usable, "__key"), fs).where(F.col("f").between(low, high) & (F.col("aa") * F.col("bb") > 0))
    s = s.withColumn("c", (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("aa") * F.col("bb")))
    top = F.max(F.struct("c", (-F.col("q")).alias("back"), "f"))
    s = s.groupBy("__key").agg(F.avg("c").alias("mean_coherence"), F.max("c").alias("max_coherence"), top.alias("top"))
    out = sizes.join(s, "__key", "left").select("__key", "n", "mean_coherence", "max_coherence", F.col("top.f").alias("at_frequency"))
    return unnamed(out, keys)


def _area(low: float, high: float) -> Column:
    """The trapezoids between neighbouring frequencies that both lie in a band."""
    inside = (F.col("f") >= low) & (F.col("f_next") < high)
    return F.coalesce(F.sum(F.when(inside, (F.col("p") + F.col("p_next")) / 2 * (F.col("f_next") - F.col("f")))), F.lit(0.0))


#: Segments of a series that are transformed in one row.
CHUNK = 16


def _chunk_powers(step: float, low: float, high: float):
    """A function of chunks of segments: their number, the first frequency's number from low to below high, and sums of powers there.

    A chunk is the stretches of CHUNK segments at most, of a grid every step seconds. The grid's points are made here, of a few
    stretches, so that none is shuffled.
    """

    @F.pandas_udf("segments long, q long, powers array<double>")
    def made(chunk: pd.Series, last: pd.Series, size: pd.Series, first: pd.Series, slope: pd.Series, base: pd.Series, rows: pd.Series) -> pd.DataFrame:
        counts, lowest, sums = np.empty(len(chunk), np.int64), np.empty(len(chunk), np.int64), np.empty(len(chunk), object)
        each = zip(chunk.to_numpy(), last.to_numpy(), size.to_numpy(), first.to_numpy(), slope.to_numpy(float), base.to_numpy(float), rows)
        for place, (c, end, n, t_first, b, a, parts) in enumerate(each):
            hop = max(n - n // 2, 1)
            starts = np.arange(c * CHUNK, min(c * CHUNK + CHUNK - 1, end) + 1) * hop
            i = np.arange(starts[0], starts[-1] + n)
            p = {k: np.array([r[k] for r in parts]) for k in ("low", "t0", "x0", "t1", "x1")}
            on = np.searchsorted(p["low"], i, side="right") - 1
            at = t_first + i * step
            x = p["x0"][on] + (at - p["t0"][on]) * (p["x1"][on] - p["x0"][on]) / (p["t1"][on] - p["t0"][on])
            # no slope: nothing but a line
            x = np.zeros(len(i)) if np.isnan(b) else x - a - b * i
            x = np.lib.stride_tricks.sliding_window_view(x, n)[starts - starts[0]]
            window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
            power = abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
            f = np.arange(power.shape[1]) * (1 / step) / n
            q = np.flatnonzero((f >= low) & (f < high))
            counts[place], lowest[place], sums[place] = len(starts), q[0] if len(q) else 0, power[:, q].sum(axis=0)
        return pd.DataFrame({"segments": counts, "q": lowest, "powers": sums})

    return made


def band_powers(rr: DataFrame, keys: list[str], t: str, value: str, fs: float = 4.0, span: float = 3600.0) -> DataFrame:
    """keys, n, lf, hf, lf_hf of intervals at times in seconds: even grid from the first time, line removed, Welch, trapezoids.

    Fewer than 8 grid points have no powers; what is left of a straight line counts as nothing. What is shuffled is intervals,
    and a row a chunk of segments with its powers within the bands; the grid's points are made twice where they are needed.
    """
    band = (0.04, 0.40)
    stretches = named(cut(series.stretches_from_start(rr, keys, 1 / fs, t, value, span)), keys)
    x, i = F.col("x"), F.col("i").cast("double")
    grid = series.points(stretches, ["__key"], 1 / fs)
    lines = grid.groupBy("__key").agg(F.count("*").alias("n"), F.regr_slope(x, i).alias("slope"), F.regr_intercept(x, i).alias("base"), F.regr_r2(x, i).alias("r2"))
    lines = cut(lines)
    usable = lines.where("n >= 8").withColumn("size", F.least(F.lit(SEGMENT), "n").cast("long"))
    bent = ~F.coalesce(F.col("r2") > 1 - 1e-14, F.lit(True))
    hop = F.greatest(F.col("size") - F.floor(F.col("size") / 2), F.lit(1)).cast("long")
    usable = usable.select("__key", "size", hop.alias("hop"), F.floor((F.col("n") - F.col("size")) / hop).alias("last"), F.when(bent, F.col("slope")).alias("slope"), F.when(bent, F.col("base")).alias("base"))
    # the chunks whose segments have points of a stretch
    begin, end = F.greatest(F.ceil((F.col("low") - F.col("size") + 1) / F.col("hop")), F.lit(0)), F.least(F.floor(F.col("high") / F.col("hop")), F.col("last"))
    dealt = stretches.join(usable, "__key").withColumn("__begin", begin).withColumn("__end", end).where("__begin <= __end")
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__begin") / CHUNK), F.floor(F.col("__end") / CHUNK))))
    of = ("last", "size", "first", "slope", "base")
    whole = dealt.groupBy("__key", "chunk").agg(*[F.first(c).alias(c) for c in of], F.sort_array(F.collect_list(F.struct("low", "t0", "x0", "t1", "x1"))).alias("rows"))
    powers = whole.select("__key", "size", _chunk_powers(1 / fs, *band)("chunk", *of, "rows").alias("s"))
    each = powers.select("__key", "size", F.col("s.segments").alias("segments"), F.col("s.q").alias("__q"), F.posexplode("s.powers").alias("place", "power"))
    q = F.col("q")
    s = each.groupBy("__key", "size", (F.col("__q") + F.col("place")).alias("q")).agg((F.sum("power") / F.sum("segments")).alias("aa"))
    one_sided = F.when((q == 0) | (q * 2 == F.col("size")), 1.0).otherwise(2.0)
    s = s.select("__key", "q", (q * F.lit(float(fs)) / F.col("size")).alias("f"), (one_sided * F.col("aa") / (fs * F.col("size") * 0.375)).alias("p"))
    w = Window.partitionBy("__key").orderBy("q")  # at most half a segment and one
    s = s.withColumn("f_next", F.lead("f").over(w)).withColumn("p_next", F.lead("p").over(w))
    s = s.groupBy("__key").agg(_area(0.04, 0.15).alias("lf"), _area(0.15, 0.40).alias("hf"))
    s = usable.select("__key").join(s, "__key", "left").select("__key", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lf", "hf")])
    all_keys = named(rr.select(*keys).distinct().withColumn("__one", F.lit(1)), keys).select("__key")
    out = all_keys.join(lines.select("__key", "n"), "__key", "left").join(s, "__key", "left")
    ratio = F.when(F.col("hf") > 0, F.col("lf") / F.col("hf"))
    return unnamed(out.select("__key", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "lf", "hf", ratio.alias("lf_hf")), keys)
