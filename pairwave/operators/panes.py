"""Sliding windows as merged panes: rows are summed once, into panes of the windows' common measure, and windows add panes up.

A window [start, start + width] has both its ends: it is the panes from its start on, of which each has its first instant and
not its last, and the rows exactly at its end, which are the first instant of the next pane and summed apart. So rows are
never copied to windows; what is dealt to them is one row a pane. Sums are of distances from the key's means, so that little
is lost in their differences.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: n, the sums of both members and the sums of their squares and products.
SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def measure(width: float, step: float) -> tuple[float, int, int]:
    """The length of a pane, and how many a window and a step have."""
    w, s = Fraction(str(width)), Fraction(str(step))
    pane = Fraction(gcd(w.numerator * s.denominator, s.numerator * w.denominator), w.denominator * s.denominator)
    return float(pane), int(w / pane), int(s / pane)


def _products(a: Column, b: Column, where: Column | None, name: str) -> list[Column]:
    kept = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    made = {"n": F.lit(1), "sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b}
    return [F.coalesce(F.sum(kept(c)), F.lit(0)).alias(f"{name}_{k}") for k, c in made.items()]


def window_sums(df: DataFrame, keys: list[str], width: float, step: float, t: str = "t", *, whole_last: bool = True) -> DataFrame:
    """__key, window_index, start and SUMS of a and b (less their means) in windows of width every step from a key's first time.

    A series shorter than a window has one. whole_last=False leaves out a last window that fits exactly. Windows without rows
    are left out.
    """
    pane, in_window, in_step = measure(width, step)
    rows = df.where(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col(t).isNotNull()).select(F.struct(*keys).alias("__key"), F.col(t).alias("__t"), "a", "b")
    spans = rows.groupBy("__key").agg(F.min("__t").alias("__t0"), F.max("__t").alias("__t1"), F.avg("a").alias("__ma"), F.avg("b").alias("__mb"))
    rest = F.greatest(F.col("__t1") - F.col("__t0") - width, F.lit(0.0))
    last = F.floor((rest + 1e-12) / step) if whole_last else F.greatest(F.ceil(rest / step) - 1, F.lit(0))
    spans = spans.withColumn("__last", last.cast("long"))
    rel = F.col("__t") - F.col("__t0")
    each = rows.join(spans, "__key").withColumn("__p", F.floor(rel / pane).cast("long"))
    at_edge = rel == F.col("__p") * F.lit(pane)
    a, b = F.col("a") - F.col("__ma"), F.col("b") - F.col("__mb")
    sums = each.groupBy("__key", "__t0", "__last", "__p").agg(*_products(a, b, None, "all"), *_products(a, b, at_edge, "edge"))
    p = F.col("__p")
    low, high = F.greatest(F.ceil((p - in_window + 1) / in_step), F.lit(0)), F.least(F.floor(p / in_step), F.col("__last"))
    part = lambda i, name: F.struct(i.cast("long").alias("window_index"), *[F.col(f"{name}_{k}").alias(k) for k in SUMS])
    whole = F.when(low <= high, F.transform(F.sequence(low, high), lambda i: part(i, "all"))).otherwise(F.array().cast("array<" + sums.select(part(F.lit(0), "all").alias("x")).schema["x"].dataType.simpleString() + ">"))
    end = F.floor((p - in_window) / in_step)
    ends_here = ((p - in_window) % in_step == 0) & (end >= 0) & (end <= F.col("__last")) & (F.col("edge_n") > 0)
    dealt = sums.select("__key", "__t0", F.explode(F.when(ends_here, F.concat(whole, F.array(part(end, "edge")))).otherwise(whole)).alias("x"))
    out = dealt.groupBy("__key", "__t0", F.col("x.window_index").alias("window_index")).agg(*[F.sum(f"x.{k}").alias(k) for k in SUMS])
    return out.select("__key", "window_index", (F.col("__t0") + F.col("window_index") * F.lit(float(step))).alias("start"), *SUMS)


def correlation(least: int = 3) -> Column:
    """Pearson's r from SUMS; null of fewer than least rows or where a member is constant but for rounding."""
    n = F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    varied = (va > 1e-12 * F.col("saa")) & (vb > 1e-12 * F.col("sbb"))
    return F.when((n >= least) & varied, (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb))
