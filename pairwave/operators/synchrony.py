"""Synchrony of paired series with built-in functions: correlation, lags, Poincare, Bland-Altman, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pearson
from . import panes


def windowed(df: DataFrame, keys: list[str], width: float, step: float, least: int = 20, t: str = "t", *, whole_last: bool = True) -> DataFrame:
    """n and r of a and b in sliding windows; windows with fewer than least samples are left out, their numbers kept."""
    sums = panes.window_sums(df, keys, width, step, t, whole_last=whole_last).where(F.col("n") >= least)
    return sums.select(*[F.col("__key")[k].alias(k) for k in keys], "window_index", "start", "n", panes.correlation().alias("r"))


def session_overlap(grid: DataFrame, keys: list[str], width: float, step: float, t: str = "t", least: int = 20) -> DataFrame:
    """Whole-session r of both members on their common grid, and the windows' mean, SD and extremes.

    A last window that fits exactly is left out, as in a loop that ends before the series' length less a window.
    """
    ok = grid.where("a is not null and b is not null")
    whole = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"), pearson(F.col("a"), F.col("b")).alias("r"))
    w = windowed(ok, keys, width, step, least, t, whole_last=False)
    w = w.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.avg("r").alias("window_mean"), F.stddev_samp("r").alias("window_sd"), F.min("r").alias("window_min"), F.max("r").alias("window_max"))
    return whole.join(w, keys, "left")


def spearman(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", *, plain: str | None = None) -> DataFrame:
    """n and rho by key: Pearson of average ranks. plain: also Pearson's r of the values, by that name."""

    def ranked(x: str) -> Column:
        # ties are counted along the order of the ranks, so that a column is sorted once
        w = Window.partitionBy(*keys).orderBy(x)
        return F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2

    ranks = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b, ranked(a).alias("__a"), ranked(b).alias("__b"))
    more = [pearson(F.col(a), F.col(b)).alias(plain)] if plain else []
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), pearson(F.col("__a"), F.col("__b")).alias("rho"), *more)


def lag_one(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """r of each member with the other one step later, their difference and who leads; below 1e-12 it is rounding."""
    w = Window.partitionBy(*keys).orderBy(order)
    nxt = df.select(*keys, "a", "b", F.lead("a").over(w).alias("a1"), F.lead("b").over(w).alias("b1"))
    out = nxt.groupBy(*keys).agg(pearson(F.col("a"), F.col("b1")).alias("r_ab"), pearson(F.col("b"), F.col("a1")).alias("r_ba"))
    asym = F.col("r_ab") - F.col("r_ba")
    sign = F.round(asym, 12)
    lead = F.when(asym.isNull(), "unavailable").when(sign > 0, "A").when(sign < 0, "B").otherwise("symmetric")
    return out.select("*", asym.alias("asymmetry"), lead.alias("leader"))


def cross_correlation(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Normalised cross-correlation of centred a and b at lags within +-most: keys, lag, c.

    At lag L, a at place i + L meets b at place i. One sort of each key's rows gives all lags, as sums of products with b
    that many rows before; only the sums are dealt to lags.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    z = df.select(*keys, order, (F.col("a") - F.avg("a").over(whole)).alias("__x"), (F.col("b") - F.avg("b").over(whole)).alias("__y"))
    lags = range(-most, most + 1)
    z = z.select(*keys, "__x", "__y", *[(F.lag("__y", n).over(w) if n > 0 else F.lead("__y", -n).over(w) if n < 0 else F.col("__y")).alias(f"__l{n + most}") for n in lags])
    sums = [F.sum(F.col("__x") * F.col(f"__l{n + most}")).alias(f"__s{n + most}") for n in lags]
    out = z.groupBy(*keys).agg(F.sqrt(F.sum(F.col("__x") * F.col("__x")) * F.sum(F.col("__y") * F.col("__y"))).alias("norm"), *sums)
    cells = F.array(*[F.struct(F.lit(n).alias("lag"), (F.col(f"__s{n + most}") / F.nullif("norm", F.lit(0.0))).alias("c")) for n in lags])
    return out.select(*keys, F.inline(cells)).where("c is not null")


def peak_lag(cc: DataFrame, keys: list[str], *, signed: bool = False) -> DataFrame:
    """The lag with the largest |c| (or c), the first of equals to 1e-12, and both naming conventions of the leader."""
    size = F.round(F.col("c") if signed else F.abs("c"), 12)
    best = cc.where("c is not null").groupBy(*keys).agg(F.max(F.struct(size.alias("s"), (-F.col("lag")).alias("l"), "c")).alias("x"))
    lag = -F.col("x.l")
    first = F.when(lag == 0, "zero_lag").when(lag > 0, "A").otherwise("B")
    second = F.when(lag == 0, "zero_lag").when(lag > 0, "B").otherwise("A")
    return best.select(*keys, lag.alias("lag"), F.col("x.c").alias("peak"), first.alias("leader_positive_lag_a"), second.alias("leader_positive_lag_b"))


def leader_vote(lag_sec: Column, asymmetry: Column, phase: Column) -> tuple[Column, Column]:
    """(leader, confidence) by majority of lag, lag-one asymmetry and mean phase difference.

    The phase votes whenever it is known, zero for B; a lag within a second and an asymmetry within 0.05 don't vote.
    """
    votes = F.array_compact(
        F.array(
            F.when(lag_sec > 1, "A").when(lag_sec < -1, "B"),
            F.when(F.abs(asymmetry) > 0.05, F.when(asymmetry > 0, "A").otherwise("B")),
            F.when(phase > 0, "A").when(phase <= 0, "B"),
        )
    )
    n, a = F.size(votes), F.size(F.filter(votes, lambda v: v == "A"))
    leader = F.when(n == 0, "UNCLEAR").when(2 * a > n, "A").when(2 * a < n, "B").otherwise("SYMMETRIC")
    sure = F.when(n == 0, 0.0).when(2 * a == n, 0.5).otherwise(F.greatest(a, n - a) / F.nullif(n, F.lit(0)))
    return leader, sure


def poincare(df: DataFrame, keys: list[str], x: str, order: str) -> DataFrame:
    """SD1, SD2 by rotation and SD2 from the total variance, their ratio, r of neighbours, RMSSD, pNN50."""
    nxt = df.select(*keys, F.col(x).alias("x"), F.lead(x).over(Window.partitionBy(*keys).orderBy(order)).alias("y"))
    d, s = F.col("y") - F.col("x"), F.col("y") + F.col("x")
    out = nxt.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("x").alias("mean_nn"),
        F.stddev_samp("x").alias("sdnn"),
        F.sqrt(F.avg(d * d)).alias("rmssd"),
        (100 * F.avg((F.abs(d) > 50).cast("double"))).alias("pnn50"),
        (F.sqrt(F.lit(0.5)) * F.stddev_samp(d)).alias("sd1"),
        (F.sqrt(F.lit(0.5)) * F.stddev_samp(s)).alias("sd2"),
        F.sqrt(F.greatest(2 * F.var_samp("x") - 0.5 * F.var_samp(d), F.lit(0.0))).alias("sd2_total"),
        pearson(F.col("x"), F.col("y")).alias("r"),
    )
    return out.withColumn("sd_ratio", F.col("sd1") / F.nullif("sd2", F.lit(0.0)))


def bland_altman(df: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Mean difference of a and b, its SD, and the limits of agreement."""
    d = F.col("a") - F.col("b")
    out = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd")).where(F.col("n") >= least)
    return out.select("*", (F.col("bias") - 1.96 * F.col("sd")).alias("lower"), (F.col("bias") + 1.96 * F.col("sd")).alias("upper"))


def ellipse(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", scale: float = 2.0) -> DataFrame:
    """Covariance ellipse of two columns (half-axes, angle) and plot limits from robust percentiles."""
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.covar_samp(a, b).alias("__c"),
        F.var_samp(a).alias("__a"),
        F.var_samp(b).alias("__b"),
        F.percentile(a, F.array(F.lit(0.005), F.lit(0.995))).alias("__p"),
    )
    half, gap = (F.col("__a") + F.col("__b")) / 2, F.sqrt(F.pow((F.col("__a") - F.col("__b")) / 2, F.lit(2)) + F.col("__c") * F.col("__c"))
    low, high = F.get("__p", 0), F.get("__p", 1)
    return out.select(
        *keys,
        "n",
        (scale * F.sqrt(half + gap)).alias("major"),
        (scale * F.sqrt(F.greatest(half - gap, F.lit(0.0)))).alias("minor"),
        F.degrees(0.5 * F.atan2(2 * F.col("__c"), F.col("__a") - F.col("__b"))).alias("angle"),
        (low - 0.2 * (high - low)).alias("limit_low"),
        (high + 0.2 * (high - low)).alias("limit_high"),
    )
