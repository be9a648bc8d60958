"""Scans along the rows of a key in pieces of time, so that no key is one task, however many rows it has.

A window function over a whole key gathers and sorts the key in one task. Here each row names its piece, its key and the
stretch of the order column (span wide) that it falls in; windows run within pieces, and what a piece needs of those before
or after it comes from one small row a piece: aggregates of each piece, combined before their shuffle, scanned along the key
and joined back on the piece. Rows, windows and that join share one shuffle by piece. Results equal those of the window over
the whole key. A piece is as large as its stretch is dense: span is chosen so that a key's rows of one span fit a task.

Rows without a place in the order come last, in a piece of their own. Null keys are keys like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Seconds of a piece where a caller names none: a week, 600,000 samples at 1 Hz.
SPAN = 7 * 86_400.0
PIECE = "__piece"
#: The number of the piece of rows without a place.
NOWHERE = (1 << 63) - 1


def pieces(df: DataFrame, keys: list[str], order: str, span: float = SPAN) -> DataFrame:
    """df with the piece of each row."""
    part = F.coalesce(F.floor(F.col(order) / span).cast("long"), F.lit(NOWHERE))
    return df.withColumn(PIECE, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], part.alias("part")))


def within(*order: str | Column) -> WindowSpec:
    """The rows of a piece in order."""
    return Window.partitionBy(PIECE).orderBy(*order)


def across(df: DataFrame, made: dict[str, Column], *carries: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """df with the columns of carries: each a function over the pieces of a key in order, of the aggregates made of each piece.

    Later ones may use earlier ones. df is read twice, once for the aggregates; who chains scans writes what lies between, or
    puts all that a scan needs into one call.
    """
    names = [f.name for f in df.schema[PIECE].dataType.fields]
    each = df.groupBy(PIECE).agg(*[c.alias(n) for n, c in made.items()])
    w = Window.partitionBy(*[F.col(PIECE)[n] for n in names[:-1]]).orderBy(F.col(PIECE)["part"])
    for carry in carries:
        each = each.select("*", *[f(w).alias(n) for n, f in carry.items()])
    return df.join(each.select(PIECE, *[n for carry in carries for n in carry]), PIECE)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def running(df: DataFrame, order: list[str | Column], name: str, value: Column | str = "1") -> DataFrame:
    """df with the sum of value over the key's rows up to this one; df has pieces."""
    value = F.expr(value) if isinstance(value, str) else value
    here = F.sum(value).over(within(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = across(df, {"__sum": F.sum(value)}, {"__base": lambda w: F.sum("__sum").over(before(w))})
    return out.withColumn(name, here + F.coalesce("__base", F.lit(0))).drop("__base")


def beside(df: DataFrame, order: list[str], values: dict[str, Column | str], *, ahead: bool = False) -> DataFrame:
    """df with values of the key's row before this one (ahead: the next one), by name; df has pieces."""
    values = {n: F.col(v) if isinstance(v, str) else v for n, v in values.items()}
    step, edge, other = (F.lead, F.min_by, lambda w: F.lead("__own").over(w)) if ahead else (F.lag, F.max_by, lambda w: F.lag("__own").over(w))
    out = across(df, {"__own": edge(F.struct(*[v.alias(n) for n, v in values.items()]), F.struct(*order))}, {"__edge": other})
    w = within(*order)
    # a null beside a row is not the end of its piece
    own = step(F.lit(True)).over(w)
    return out.select("*", *[F.when(own, step(v).over(w)).otherwise(F.col("__edge")[n]).alias(n) for n, v in values.items()]).drop("__edge")


def known(df: DataFrame, order: list[str], value: Column, name: str, *, ahead: bool = False) -> DataFrame:
    """df with the last value so far that isn't null (ahead: the first from here on), this row's included; df has pieces."""
    down = [F.col(o).desc() for o in order] if ahead else [F.col(o).asc() for o in order]
    here = F.last(value, True).over(within(*down).rowsBetween(Window.unboundedPreceding, 0))
    # the order's columns within the value's row, so that an unknown value is no row
    edge = (F.min if ahead else F.max)(F.when(value.isNotNull(), F.struct(*order, value.alias("__v"))))
    rest = (lambda w: F.first("__own", True).over(after(w))) if ahead else (lambda w: F.last("__own", True).over(before(w)))
    out = across(df, {"__own": edge}, {"__edge": rest})
    return out.withColumn(name, F.coalesce(here, F.col("__edge")["__v"])).drop("__edge")


def overlapping(df: DataFrame, keys: list[str], place: str, size: int, reach: int) -> DataFrame:
    """df's rows dealt to pieces of size places of a counted column, each with the rows up to reach places beyond either edge.

    Windows within a piece that reach no further have all their rows for those that are __own, however long a piece is; others
    are only there to be seen.
    """
    part = lambda d: F.floor((F.col(place) + d) / size).cast("long")
    out = df.withColumn("__part", F.explode(F.sequence(part(-reach), part(reach)))).withColumn("__own", F.col("__part") == part(0))
    return out.withColumn(PIECE, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("__part").alias("part"))).drop("__part")
