"""Aggregate expressions with defined results on short and constant series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def both(x: Column, y: Column) -> Column:
    """x where y is present too."""
    return F.when(y.isNotNull(), x)


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson's r over the rows where both are present; null below ``least`` of them or for a constant series.

    The covariance form, as ``corr`` raises on a constant series in ANSI mode.
    """
    x, y = both(x, y), both(y, x)
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(F.count(x) >= least, F.covar_samp(x, y) / F.nullif(spread, F.lit(0.0)))


def share(condition: Column) -> Column:
    """The share of rows with a condition, of those where it is defined."""
    return F.avg(condition.cast("double"))


def mean_ci(x: Column, z: float = 1.96) -> dict[str, Column]:
    """Mean and the half-width of its normal confidence interval."""
    return {"mean": F.avg(x), "half_width": z * F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))}


def reliability_label(r: Column, good: float = 0.75, fair: float = 0.5) -> Column:
    return F.when(r.isNull(), "unavailable").when(r >= good, "reliable").when(r >= fair, "caution").otherwise("low")


def rounded(x: Column, digits: int = 6) -> Column:
    """x rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
