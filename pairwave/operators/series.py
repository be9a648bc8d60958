"""Time series by key: gaps, intervals, grids, interpolation, windows, scores. Windows and joins only, no Python.

What runs along a whole series (numbers, neighbours, running sums, last known values) is scanned in pieces of time, see
``scan``; span is the width of a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .scan import SPAN


#: Grid points that a row makes at once.
GRID_PART = 4096


def gap_groups(df: DataFrame, keys: list[str], start: str, max_gap: float, tie: str, span: float = SPAN) -> DataFrame:
    """df with group (from 1): a new one begins after a gap of more than max_gap between starts, or at an unknown start.

    Unknown starts come last, each in a group of its own.
    """
    opens = lambda gap: F.when(gap.isNull() | (gap > max_gap), 1).otherwise(0)
    w = scan.within(start, tie)
    out = scan.pieces(df, keys, start, span)
    # within a piece all but the first row, whose gap is to the piece before
    own = F.when(F.row_number().over(w) > 1, opens(F.col(start) - F.lag(start).over(w))).otherwise(0)
    out = out.withColumn("__own", own)
    made = {"__low": F.min(start), "__high": F.max(start), "__opens": F.sum("__own")}
    first = {"__first": lambda w: opens(F.col("__low") - F.lag("__high").over(w))}
    base = {"__base": lambda w: F.coalesce(F.sum(F.col("__opens") + F.col("__first")).over(scan.before(w)), F.lit(0))}
    out = scan.across(out, made, first, base)
    here = F.sum("__own").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("group", here + F.col("__first") + F.col("__base")).drop("__own", "__first", "__base", scan.PIECE)


def numbered(df: DataFrame, keys: list[str], *order: str, name: str = "n", span: float | None = None) -> DataFrame:
    """df with a count from 1 in each group. span: cuts long groups by their first order column, a number."""
    if span is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return scan.running(scan.pieces(df, keys, order[0], span), list(order), name, F.lit(1)).drop(scan.PIECE)


def intervals(peaks: DataFrame, keys: list[str], t: str = "t", span: float = SPAN) -> DataFrame:
    """Intervals between neighbouring peaks (times in seconds): start, end, middle, rr_ms, hr_bpm, interval_number.

    Intervals that are not positive are dropped and the rest numbered from 1.
    """
    w = scan.within("start")
    cut = scan.pieces(peaks.select(*keys, F.col(t).alias("start")).where("start is not null"), keys, "start", span)
    cut = cut.withColumn("__next", F.lead("start").over(w)).withColumn("__own", F.when(F.col("__next") > F.col("start"), 1).otherwise(0))
    # the last peak of a piece has its interval with the first of the next piece, which is later
    made = {"__low": F.min("start"), "__n": F.sum("__own") + 1}
    carry = {"__ahead": lambda w: F.lead("__low").over(w), "__base": lambda w: F.coalesce(F.sum("__n").over(scan.before(w)), F.lit(0))}
    out = scan.across(cut, made, carry)
    last = F.lead("start").over(w).isNull()
    out = out.withColumn("end", F.when(last, F.col("__ahead")).otherwise(F.col("__next")))
    out = out.withColumn("interval_number", F.col("__base") + F.sum("__own").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.when(last, 1).otherwise(0))
    out = out.where("end > start").select(*keys, "start", "end", "interval_number")
    out = out.select("*", ((F.col("start") + F.col("end")) / 2).alias("middle"), ((F.col("end") - F.col("start")) * 1000).alias("rr_ms"))
    return out.withColumn("hr_bpm", 60000 / F.col("rr_ms"))


def to_grid(samples: DataFrame, keys: list[str], step: float, t: str = "t", x: str = "x", tie: str | None = None, span: float = SPAN) -> DataFrame:
    """Linear interpolation at the multiples of step within each series' support: keys, k, t, x.

    Each stretch between neighbouring samples makes its own grid points, so there is no join with a grid.
    """
    # a stretch over a long gap makes its points by the thousand, so no row holds them all
    part = stretches(samples, keys, step, t, x, tie, span).withColumn("__k", F.explode(F.sequence("low", "high", F.lit(GRID_PART).cast("long"))))
    points = part.withColumn("k", F.explode(F.sequence("__k", F.least(F.col("__k") + GRID_PART - 1, F.col("high"))))).drop("__k")
    at = F.col("k") * F.lit(float(step))
    value = F.when(F.col("t1").isNull(), F.col("x0")).otherwise(F.col("x0") + (at - F.col("t0")) * (F.col("x1") - F.col("x0")) / (F.col("t1") - F.col("t0")))
    return points.select(*keys, "k", at.alias("t"), value.alias("x"))


def stretches(samples: DataFrame, keys: list[str], step: float, t: str = "t", x: str = "x", tie: str | None = None, span: float = SPAN) -> DataFrame:
    """keys, t0, x0, t1, x1, low, high: stretches between neighbouring samples and the multiples of step that lie on them, if any.

    A stretch is open at its end, but for a series' last one; a lone sample is a stretch without end. Of samples at one time
    the first by tie counts.
    """
    rows = samples.where(F.col(t).isNotNull() & F.col(x).isNotNull()).select(*keys, F.col(t).alias("t0"), F.col(x).alias("x0"), F.col(tie or x).alias("__tie"))
    cut = scan.pieces(rows, keys, "t0", span)
    # samples at one time are in one piece
    w = scan.within("t0", "__tie")
    once = cut.withColumn("__new", F.coalesce(F.lag("t0").over(w) < F.col("t0"), F.lit(True))).where("__new").drop("__new")
    w = scan.within("t0")
    once = once.withColumn("__t1", F.lead("t0").over(w)).withColumn("__x1", F.lead("x0").over(w))
    ends = {"__low": F.min("t0"), "__high": F.max("t0"), "__x": F.min_by("x0", F.struct("t0", "__tie"))}
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = {
        "__next_t": lambda w: F.lead("__low").over(w),
        "__next_x": lambda w: F.lead("__x").over(w),
        "__first": lambda w: F.min("__low").over(whole(w)),
        "__end": lambda w: F.max("__high").over(whole(w)),
    }
    out = scan.across(once, ends, carry).withColumn("t1", F.coalesce("__t1", "__next_t"))
    out = out.withColumn("x1", F.when(F.col("__t1").isNull(), F.col("__next_x")).otherwise(F.col("__x1")))
    low = F.ceil(F.col("t0") / step)
    end = F.floor(F.col("t1") / step)
    high = F.when(F.col("t1").isNull(), F.floor(F.col("t0") / step)).when((F.col("t1") < F.col("__end")) & (end * step == F.col("t1")), end - 1).otherwise(end)
    made = out.select(*keys, "t0", "x0", "t1", "x1", low.alias("low"), high.alias("high"), (F.col("t0") == F.col("__first")).alias("__lone"))
    return made.where("high >= low and (t1 is not null or __lone)").drop("__lone")


def stretches_from_start(samples: DataFrame, keys: list[str], step: float, t: str = "t", x: str = "x", span: float = SPAN) -> DataFrame:
    """keys, first (the series' first time), t0, x0, t1, x1, low, high: stretches between neighbouring samples and the grid points
    (from_start's i) that lie on them, of which a row has at most GRID_PART."""
    rows = samples.where(F.col(t).isNotNull() & F.col(x).isNotNull()).select(*keys, F.col(t).alias("t0"), F.col(x).alias("x0"))
    w = scan.within("t0", "x0")
    once = scan.pieces(rows, keys, "t0", span).withColumn("__new", F.coalesce(F.lag("t0").over(w) < F.col("t0"), F.lit(True))).where("__new").drop("__new")
    once = once.withColumn("__t1", F.lead("t0").over(scan.within("t0"))).withColumn("__x1", F.lead("x0").over(scan.within("t0")))
    ends = {"__low": F.min("t0"), "__x": F.min_by("x0", F.struct("t0", "x0"))}
    carry = {
        "__next_t": lambda w: F.lead("__low").over(w),
        "__next_x": lambda w: F.lead("__x").over(w),
        "first": lambda w: F.min("__low").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }
    out = scan.across(once, ends, carry).withColumn("t1", F.coalesce("__t1", "__next_t"))
    out = out.withColumn("x1", F.when(F.col("__t1").isNull(), F.col("__next_x")).otherwise(F.col("__x1")))
    out = out.withColumn("__low", F.ceil((F.col("t0") - F.col("first")) / step)).withColumn("__high", F.ceil((F.col("t1") - F.col("first")) / step) - 1)
    # a long gap makes its points by the thousand, so no row holds them all
    part = out.where("__low <= __high").withColumn("low", F.explode(F.sequence("__low", "__high", F.lit(GRID_PART).cast("long"))))
    return part.select(*keys, "first", "t0", "x0", "t1", "x1", "low", F.least(F.col("low") + GRID_PART - 1, F.col("__high")).alias("high"))


def points(stretches: DataFrame, keys: list[str], step: float) -> DataFrame:
    """keys, i, t, x of the grid points of stretches_from_start."""
    at = F.col("first") + F.col("i") * F.lit(float(step))
    each = stretches.withColumn("i", F.explode(F.sequence("low", "high")))
    return each.select(*keys, "i", at.alias("t"), (F.col("x0") + (at - F.col("t0")) * (F.col("x1") - F.col("x0")) / (F.col("t1") - F.col("t0"))).alias("x"))


def from_start(samples: DataFrame, keys: list[str], step: float, t: str = "t", x: str = "x", span: float = SPAN) -> DataFrame:
    """Linear interpolation every step from each series' first time on, its last time excluded: keys, i (from 0), t, x."""
    return points(stretches_from_start(samples, keys, step, t, x, span), keys, step)


def paired(grid: DataFrame, member: str, x: str = "x") -> DataFrame:
    """Series 2d and 2d+1 side by side at common grid points: dyad, k, t, a, b."""
    dyad = F.floor(F.col(member) / 2).cast("long").alias("dyad")
    a = grid.where(F.col(member) % 2 == 0).select(dyad, "k", "t", F.col(x).alias("a"))
    b = grid.where(F.col(member) % 2 == 1).select(dyad, "k", F.col(x).alias("b"))
    return a.join(b, ["dyad", "k"])


def sliding(df: DataFrame, keys: list[str], width: float, step: float, t: str = "t", *, whole_last: bool = True) -> DataFrame:
    """Rows dealt to windows of width (both ends included) every step from the key's first time: adds window_index, start.

    A series shorter than a window has one. whole_last=False leaves out a last window that fits exactly. A row names its
    own windows, at most width/step + 1, so nothing is joined.
    """
    w = Window.partitionBy(*keys)
    out = df.withColumn("__t0", F.min(t).over(w)).withColumn("__span", F.greatest(F.max(t).over(w) - F.min(t).over(w) - width, F.lit(0.0)))
    last = F.floor((F.col("__span") + 1e-12) / step) if whole_last else F.greatest(F.ceil(F.col("__span") / step) - 1, F.lit(0))
    rel = F.col(t) - F.col("__t0")
    low, high = F.greatest(F.ceil((rel - width) / step), F.lit(0)), F.least(F.floor(rel / step), last)
    out = out.withColumn("__low", low).withColumn("__high", high).where("__low <= __high")
    out = out.withColumn("window_index", F.explode(F.sequence("__low", "__high")))
    return out.withColumn("start", F.col("__t0") + F.col("window_index") * step).drop("__t0", "__span", "__low", "__high")


def runs(df: DataFrame, keys: list[str], step: float, tolerance: float, t: str = "t", span: float = SPAN) -> DataFrame:
    """df with run (from 1) and pos (from 0): a run breaks where neighbours aren't one step apart."""
    breaks = lambda gap: F.when(F.abs(gap - step) <= tolerance, 0).otherwise(1)
    w = scan.within(t)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = scan.pieces(df, keys, t, span).withColumn("__n", F.row_number().over(w))
    # within a piece all but the first row, whose gap is to the piece before
    out = out.withColumn("__own", F.when(F.col("__n") > 1, breaks(F.col(t) - F.lag(t).over(w))).otherwise(0))
    broken = F.when(F.col("__own") == 1, F.col("__n"))
    made = {"__low": F.min(t), "__high": F.max(t), "__rows": F.count("*"), "__breaks": F.sum("__own"), "__last": F.max(broken)}
    first = {"__first": lambda w: breaks(F.col("__low") - F.lag("__high").over(w)), "__base": lambda w: F.coalesce(F.sum("__rows").over(scan.before(w)), F.lit(0))}
    begins = F.coalesce(F.col("__base") + F.col("__last"), F.when(F.col("__first") == 1, F.col("__base") + 1))
    carry = {
        "__run": lambda w: F.coalesce(F.sum(F.col("__breaks") + F.col("__first")).over(scan.before(w)), F.lit(0)),
        "__begin": lambda w: F.last(begins, True).over(scan.before(w)),
    }
    out = scan.across(out, made, first, carry)
    begin = F.coalesce(F.col("__base") + F.max(broken).over(so_far), F.when(F.col("__first") == 1, F.col("__base") + 1), "__begin")
    out = out.withColumn("run", F.col("__run") + F.col("__first") + F.sum("__own").over(so_far))
    return out.withColumn("pos", F.col("__base") + F.col("__n") - begin).drop("__n", "__own", "__first", "__base", "__run", "__begin", scan.PIECE)


def count_windows(df: DataFrame, keys: list[str], size: int, step: int) -> DataFrame:
    """Rows with run and pos dealt to windows of size rows every step rows of a run, whole windows only: adds window."""
    n = F.count("*").over(Window.partitionBy(*keys, "run"))
    out = df.withColumn("__last", F.floor((n - size) / step))
    low, high = F.greatest(F.ceil((F.col("pos") - size + 1) / step), F.lit(0)), F.least(F.floor(F.col("pos") / step), F.col("__last"))
    out = out.withColumn("__low", low).withColumn("__high", high).where("__low <= __high")
    return out.withColumn("window", F.explode(F.sequence("__low", "__high"))).drop("__last", "__low", "__high")


def zscore(x: str, keys: list[str], ddof: int = 1) -> Column:
    """(x - mean) / SD over the key; null for a constant series. ddof 1: sample SD, 0: population SD."""
    w = Window.partitionBy(*keys)
    sd = (F.stddev_samp if ddof else F.stddev_pop)(x).over(w)
    return (F.col(x) - F.avg(x).over(w)) / F.nullif(sd, F.lit(0.0))


def detrended(df: DataFrame, keys: list[str], x: str, order: str, name: str) -> DataFrame:
    """df with the residuals of x after a line over its place in the series."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("__i", F.row_number().over(w.orderBy(order)).cast("double"))
    slope, base = F.regr_slope(F.col(x), F.col("__i")).over(w), F.regr_intercept(F.col(x), F.col("__i")).over(w)
    return out.withColumn(name, F.col(x) - base - slope * F.col("__i")).drop("__i")


def filled(df: DataFrame, keys: list[str], x: str, order: str, name: str, span: float = 100_000) -> DataFrame:
    """df with gaps of x filled linearly over the place in the series; the ends hold their nearest value.

    order is a number, and a piece is span of it wide. What comes next is the last so far in the opposite order, so each row is
    looked at once either way.
    """
    out = scan.pieces(df, keys, order, span).withColumn("__n", F.row_number().over(scan.within(order)))
    value = F.when(F.col(x).isNotNull(), F.struct(F.col("__n").alias("n"), F.col(x).alias("x")))
    seen = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(c)["n"] + F.col("__base")).alias("n"), F.col(c)["x"].alias("x")))
    made = {"__rows": F.count("*"), "__low": F.min(value), "__high": F.max(value)}
    carry = {
        "__back": lambda w: F.last(seen("__high"), True).over(scan.before(w)),
        "__ahead": lambda w: F.first(seen("__low"), True).over(scan.after(w)),
    }
    out = scan.across(out, made, {"__base": lambda w: F.coalesce(F.sum("__rows").over(scan.before(w)), F.lit(0))}, carry)
    out = out.withColumn("__i", F.col("__n") + F.col("__base"))
    here = F.when(F.col(x).isNotNull(), F.struct(F.col("__i").alias("n"), F.col(x).alias("x")))
    so_far = lambda o: F.last(here, True).over(scan.within(o).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("__a", F.coalesce(so_far(F.asc("__n")), "__back")).withColumn("__b", F.coalesce(so_far(F.desc("__n")), "__ahead"))
    line = F.col("__a.x") + (F.col("__i") - F.col("__a.n")) * (F.col("__b.x") - F.col("__a.x")) / F.nullif(F.col("__b.n") - F.col("__a.n"), F.lit(0))
    return out.withColumn(name, F.coalesce(x, line, "__a.x", "__b.x")).drop("__n", "__base", "__back", "__ahead", "__i", "__a", "__b", scan.PIECE)


def prepared_pairs(df: DataFrame, keys: list[str], order: str, *, least: int = 20, line: bool = True) -> DataFrame:
    """df's rows with both a and b, as za and zb without their lines (line) and standardised, and status by key.

    status: success, too_few_samples (fewer than least of both), or zero_sd, where nothing but a line is left of one.
    """
    w = Window.partitionBy(*keys)
    out = df.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    for x in "ab":
        out = detrended(out, keys, x, order, f"z{x}") if line else out.withColumn(f"z{x}", F.col(x) - F.avg(x).over(w))
    n = F.count("*").over(w)
    flat = F.greatest(*[F.stddev_pop(f"z{x}").over(w) <= 1e-9 * F.max(F.abs(F.col(x))).over(w) for x in "ab"])
    status = F.when(n < least, "too_few_samples").when(flat, "zero_sd").otherwise("success")
    out = out.withColumn("status", status)
    z = [F.when(F.col("status") == "success", (F.col(f"z{x}") - F.avg(f"z{x}").over(w)) / F.nullif(F.stddev_pop(f"z{x}").over(w), F.lit(0.0))).alias(f"z{x}") for x in "ab"]
    return out.select(*[c for c in out.columns if c not in ("za", "zb")], *z)


def timeline(df: DataFrame, keys: list[str], segment: list[str], t: str = "t", pause: float = 5.0) -> DataFrame:
    """df with line_t: segments one after another, each at the running sum of the spans before it, plus a pause each."""
    spans = df.groupBy(*keys, *segment).agg(F.min(t).alias("__t0"), (F.max(t) - F.min(t) + pause).alias("__span"))
    w = Window.partitionBy(*keys).orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__offset", F.coalesce(F.sum("__span").over(w), F.lit(0.0)))
    return df.join(spans, [*keys, *segment]).withColumn("line_t", F.col(t) - F.col("__t0") + F.col("__offset")).drop("__t0", "__span", "__offset")
