"""Dependence within pairs from sums and joins: Granger causality by lagged Gram matrices, cross-recurrence by cells.

Both need a series' rows only with their neighbours, which overlapping pieces give, so a pair of any length is spread. The
Gram matrices are sums in the JVM; Python solves systems of at most a dozen unknowns, many at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan, series
from .signal import f_test_p
from .spectra import named, unnamed

#: Rows of a piece.
SIZE = 65_536


def scored(pairs: DataFrame, keys: list[str], order: str, span: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(__key, i from 0, a and b standardised by their population SD), and (__key, n, sd_a, sd_b) of rows with both.

    A constant series has no standardised rows; one counts as constant when its SD is nothing beside its size.
    """
    rows = series.numbered(pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()), keys, order, name="i", span=span)
    rows = named(rows.select(*keys, (F.col("i") - 1).alias("i"), "a", "b"), keys)
    sums = [f(F.col(x)).alias(f"{n}_{x}") for x in "ab" for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    means = rows.groupBy("__key").agg(F.count("*").alias("n"), *sums)
    varied = means.where("sd_a > 1e-12 * (1 + abs(mean_a)) and sd_b > 1e-12 * (1 + abs(mean_b))")
    z = [((F.col(x) - F.col(f"mean_{x}")) / F.col(f"sd_{x}")).alias(x) for x in "ab"]
    return rows.join(varied, "__key").select("__key", "i", "n", *z), means.join(varied.select("__key", F.lit(True).alias("varied")), "__key", "left")


def _differences(x: str, most: int) -> list[Column]:
    """The past of x as the last value and its differences of order 1 to most - 1, which span what the lags 1 to most do."""
    w = scan.within("i")
    lags, out = [F.lag(x, j).over(w) for j in range(1, most + 1)], []
    now = lags
    for _ in range(most):
        out.append(now[0])
        now = [u - v for u, v in zip(now, now[1:])]
    return out


def granger(pairs: DataFrame, keys: list[str], order: str, most: int = 5, size: int = SIZE, span: float | None = None) -> DataFrame:
    """keys, n, p_ab, p_ba, direction, error: the least p over lags 1 to most of the F test that one series' past helps
    predict the other.

    The products of all pairs of terms are summed once for each number of lags that a row has, 1 to most.
    """
    z, means = scored(pairs, keys, order, span)
    rows = scan.overlapping(z, ["__key"], "i", size, most)
    w = scan.within("i")
    past = [c.alias(f"{x}{j}") for x in "ab" for j, c in enumerate(_differences(x, most))]
    # the change is explained instead of the value, as the last value is among the terms
    change = [(F.col(x) - F.lag(x).over(w)).alias(f"y{x}") for x in "ab"]
    rows = rows.select("__key", "i", "__own", F.lit(1.0).alias("one"), *past, *change).where("__own and i > 0")
    terms = ["one", *(f"{x}{j}" for j in range(most) for x in "ab"), "ya", "yb"]
    products = [F.sum(F.col(u) * F.col(v)).alias(f"{u}_{v}") for k, u in enumerate(terms) for v in terms[k:]]
    sums = rows.groupBy("__key", F.least("i", F.lit(most)).alias("lags")).agg(*products)
    gram = F.array(*[F.coalesce(F.col(f"{terms[min(a, b)]}_{terms[max(a, b)]}"), F.lit(0.0)) for a in range(len(terms)) for b in range(len(terms))])
    # a key has at most `most` of these
    whole = sums.groupBy("__key").agg(F.collect_list(F.struct("lags", gram.alias("gram"))).alias("grams"))

    @F.pandas_udf("p_ab double, p_ba double")
    def tests(grams: pd.Series) -> pd.DataFrame:
        size = len(terms)

        def rest(g: np.ndarray, x: list[int], y: int) -> float:
            m, v = g[np.ix_(x, x)], g[x, y]
            scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
            beta = np.linalg.lstsq(m / np.outer(scale, scale), v / scale, rcond=1e-14)[0] / scale
            return max(g[y, y] - 2 * beta @ v + beta @ m @ beta, 0.0)

        def both(found: list[dict]) -> tuple[float, float]:
            by = {r["lags"]: np.reshape(r["gram"], (size, size)) for r in found}
            out = []
            for effect, cause in (("b", "a"), ("a", "b")):
                y, ps = terms.index(f"y{effect}"), []
                for k in range(1, most + 1):
                    g = sum(by.get(c, 0) for c in range(k, most + 1))
                    own = [0, *(terms.index(f"{effect}{j}") for j in range(k))]
                    r0, r1 = rest(g, own, y), rest(g, [*own, *(terms.index(f"{cause}{j}") for j in range(k))], y)
                    free = round(g[0, 0]) - 2 * k - 1
                    ps.append(f_test_p((r0 - r1) / k / (r1 / free), k, free) if r1 > 0 else 0.0)
                out.append(min(ps))
            return out[0], out[1]

        return pd.DataFrame([both(x) for x in grams], columns=["p_ab", "p_ba"])

    p = whole.join(means.where(F.col("n") > 3 * most + 2).select("__key"), "__key").select("__key", tests("grams").alias("t")).select("__key", "t.p_ab", "t.p_ba")
    out = means.join(p, "__key", "left")
    enough = F.col("n") > 3 * most + 2
    named_ = F.when((F.col("p_ab") < 0.05) & (F.col("p_ba") < 0.05), "both").when(F.col("p_ab") < 0.05, "A").when(F.col("p_ba") < 0.05, "B").otherwise("none")
    direction = F.when(~enough, "unavailable").when(F.col("varied"), named_)
    error = F.when(enough & F.col("varied").isNull(), "a constant series")
    return unnamed(out.select("__key", "n", "p_ab", "p_ba", direction.alias("direction"), error.alias("error")), keys)


def recurrences(z: DataFrame, dim: int, delay: int, radius: float, size: int = SIZE) -> DataFrame:
    """__key, i, j of embedded points of a and b at most radius apart; z: __key, i, a, b.

    Points are dealt to strips of the first coordinate, radius wide, so a point meets those of its own strip and of the two beside
    it only. Cells of all coordinates would meet fewer, but of each point 3^dim copies were shuffled and sorted, not 3.
    """
    w = scan.within("i")
    rows = scan.overlapping(z, ["__key"], "i", size, delay * (dim - 1))
    rows = rows.select("__key", "i", "__own", *[F.lead(x, j * delay).over(w).alias(f"{x}{j}") for x in "ab" for j in range(dim)]).where("__own")
    rows = rows.where(F.col(f"a{dim - 1}").isNotNull())
    strip = lambda x: F.floor(F.col(f"{x}0") / radius)
    left = rows.select("__key", "i", *[f"a{j}" for j in range(dim)], strip("a").alias("strip"))
    right = rows.select("__key", F.col("i").alias("j"), *[f"b{j}" for j in range(dim)], F.explode(F.array(*[strip("b") + d for d in (-1, 0, 1)])).alias("strip"))
    apart = reduce(lambda u, v: u + v, [(F.col(f"a{j}") - F.col(f"b{j}")) * (F.col(f"a{j}") - F.col(f"b{j}")) for j in range(dim)])
    return left.join(right, ["__key", "strip"]).where(apart <= radius**2).select("__key", "i", "j")


def _lines(points: DataFrame, line: Column) -> DataFrame:
    """__key, length, lines: how many unbroken lines of each length there are along i."""
    w = Window.partitionBy("__key", "line").orderBy("i")
    each = points.withColumn("line", line).withColumn("begin", F.col("i") - F.row_number().over(w))
    return each.groupBy("__key", "line", "begin").agg(F.count("*").alias("length")).groupBy("__key", "length").agg(F.count("*").alias("lines"))


def cross_recurrence(pairs: DataFrame, keys: list[str], order: str, dim: int = 3, delay: int = 1, radius: float = 0.1, least: int = 50, span: float | None = None) -> DataFrame:
    """keys, n, recurrence rate, determinism, mean, longest and entropy of diagonals, laminarity, trapping time of verticals, error.

    The n x n picture is never made: its points come from a join on cells, its lines from gaps and islands along them.
    """
    z, means = scored(pairs, keys, order, span)
    points = recurrences(z.where(F.col("n") >= least), dim, delay, radius)
    count = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    long = F.when(F.col("length") >= 2, F.col("lines"))
    diagonals, verticals = _lines(points, F.col("j") - F.col("i")), _lines(points, F.col("j"))
    ln = F.sum(long * F.log(F.col("lines").cast("double")))
    d = diagonals.groupBy("__key").agg(count(long * F.col("length"), "d_points"), count(long, "d_lines"), F.max(F.when(F.col("length") >= 2, F.col("length"))).alias("d_max"), ln.alias("d_ln"))
    v = verticals.groupBy("__key").agg(F.sum(F.col("lines") * F.col("length")).alias("total"), count(long * F.col("length"), "v_points"), count(long, "v_lines"))
    out = means.join(d, "__key", "left").join(v, "__key", "left")
    m = F.col("n") - delay * (dim - 1)
    used, some = F.col("varied") & (F.col("n") >= least), F.col("total").isNotNull()
    mean = lambda p, q: F.when(some, F.when(F.col(q) > 0, F.col(p) / F.col(q)).otherwise(0.0))
    entropy = F.when(some, F.when(F.col("d_lines") > 0, F.log(F.col("d_lines").cast("double")) - F.col("d_ln") / F.col("d_lines")).otherwise(0.0))
    made = {
        "rr": F.when(used, F.coalesce("total", F.lit(0)) / (m * m)),
        "det": F.when(some, F.col("d_points") / F.col("total")),
        "l_mean": mean("d_points", "d_lines"),
        "l_max": F.when(some, F.coalesce(F.col("d_max").cast("double"), F.lit(0.0))),
        "entropy": entropy,
        "lam": F.when(some, F.col("v_points") / F.col("total")),
        "tt": F.when(some & (F.col("v_lines") > 0), F.col("v_points") / F.col("v_lines")),
        "error": F.when((F.col("n") >= least) & F.col("varied").isNull(), "a constant series"),
    }
    return unnamed(out.select("__key", "n", *[c.alias(k) for k, c in made.items()]), keys)


def _lengths(places: np.ndarray) -> np.ndarray:
    """The lengths of the stretches of consecutive numbers among sorted ones."""
    ends = np.flatnonzero(np.diff(places, append=places[-1] + 2) != 1)
    return np.diff(ends, prepend=-1)


def block_recurrence(a: np.ndarray, b: np.ndarray, dim: int = 3, delay: int = 1, radius: float = 0.1) -> dict[str, float]:
    """The measures of cross_recurrence of two standardised series that are short enough for the whole picture; null ones are left out."""
    n = len(a) - delay * (dim - 1)
    apart = (a[:, None] - b) ** 2
    apart = reduce(lambda u, v: u + v, [apart[j * delay : j * delay + n, j * delay : j * delay + n] for j in range(dim)])
    i, j = np.nonzero(apart <= radius**2)
    if not len(i):
        return {"rr": 0.0}
    # numbers that go on along a line and jump from one to the next
    d, v = (_lengths(np.sort(line * 2 * n + i)) for line in (j - i, j))
    d, v = d[d >= 2], v[v >= 2]
    out = {"rr": len(i) / (n * n), "det": d.sum() / len(i), "l_mean": 0.0, "l_max": 0.0, "entropy": 0.0, "lam": v.sum() / len(i)}
    if len(d):
        lines = np.unique(d, return_counts=True)[1]
        out |= {"l_mean": d.sum() / len(d), "l_max": float(d.max()), "entropy": np.log(len(d)) - (lines * np.log(lines)).sum() / len(d)}
    return out | ({"tt": v.sum() / len(v)} if len(v) else {})


def recurrence_of(trials: Callable, dim: int = 3, delay: int = 1, radius: float = 0.1, least: int = 50) -> DataFrame:
    """cross_recurrence of trials, which are bounded: the points of one are made and counted where it is, none is shuffled.

    trials: blocks.by_trial or by_block without their last two arguments.
    """
    names = ("rr", "det", "l_mean", "l_max", "entropy", "lam", "tt")

    def kernel(place: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        if a.shape[1] < least:
            return {}
        made, error = np.full((len(names), len(a)), np.nan), np.full(len(a), None, object)
        mean, sd = zip(*((x.mean(axis=1, keepdims=True), x.std(axis=1, keepdims=True)) for x in (a, b)))
        varied = np.all([s > 1e-12 * (1 + np.abs(m)) for m, s in zip(mean, sd)], axis=0)[:, 0]
        error[~varied] = "a constant series"
        a, b = ((x - m) / np.where(s > 0, s, 1.0) for x, m, s in zip((a, b), mean, sd))
        for i in np.flatnonzero(varied):
            found = block_recurrence(a[i], b[i], dim, delay, radius)
            made[:, i] = [found.get(c, np.nan) for c in names]
        return dict(zip(names, made)) | {"error": error}

    return trials(kernel, ", ".join(f"{c} double" for c in names) + ", error string")
