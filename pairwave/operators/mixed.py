"""A random-intercept model of one variable on another by restricted maximum likelihood, and its spread over splits.

The criterion needs no row of the data: at a variance ratio theta a person with n rows has the weight theta / (1 + n theta),
so persons with equally many rows count together, by the sums of products of their sums. Spark adds up rows to persons and
persons to sizes; what is left of a stratum is one short row for each size, on which a pandas function solves 2x2 systems.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import halves, series
from .signal import beta_cdf

#: Sums by size: persons, sums of x and y of persons, products of these, and sums of squares and products of rows.
SUMS = ("persons", "x", "y", "px", "pxy", "py", "xx", "xy", "yy")


class Model:
    """The profile of the criterion over theta for sums by size (m rows a person)."""

    def __init__(self, m: np.ndarray, sums: dict[str, np.ndarray]):
        self.m, self.s = m.astype(float), sums
        self.n = float(m @ sums["persons"])

    def criteria(self, thetas: np.ndarray) -> np.ndarray:
        """-2 REML at each of several ratios."""
        m, s, t = self.m, self.s, np.atleast_1d(thetas)[:, None]
        k = t / (1 + m * t)
        a00, a01, a11 = self.n - k @ (m * m * s["persons"]), s["x"].sum() - k @ (m * s["x"]), s["xx"].sum() - k @ s["px"]
        b0, b1 = s["y"].sum() - k @ (m * s["y"]), s["xy"].sum() - k @ s["pxy"]
        det = a00 * a11 - a01 * a01
        fitted = (a11 * b0 * b0 - 2 * a01 * b0 * b1 + a00 * b1 * b1) / det
        rest = np.maximum(s["yy"].sum() - k @ s["py"] - fitted, 1e-300)
        return (self.n - 2) * np.log(rest / (self.n - 2)) + np.log1p(m * t) @ s["persons"] + np.log(np.abs(det))

    def at(self, theta: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        """(-2 REML criterion, coefficients, their covariance, residual variance)."""
        m, s = self.m, self.s
        k = theta / (1 + m * theta)
        a01 = s["x"].sum() - k @ (m * s["x"])
        a = np.array([[self.n - k @ (m * m * s["persons"]), a01], [a01, s["xx"].sum() - k @ s["px"]]])
        b = np.array([s["y"].sum() - k @ (m * s["y"]), s["xy"].sum() - k @ s["pxy"]])
        beta = np.linalg.solve(a, b)
        s2 = max(float(s["yy"].sum() - k @ s["py"] - beta @ b), 1e-300) / (self.n - 2)
        return float(self.criteria(theta)[0]), beta, s2 * np.linalg.inv(a), s2

    def best(self) -> float:
        """The ratio of the least criterion: the best of a grid, and of finer ones around it."""
        grid = np.concatenate(([0.0], np.geomspace(1e-6, 1e6, 121)))
        values = self.criteria(grid)
        zero = values[0]
        for _ in range(12):
            i = int(np.argmin(values))
            grid = np.linspace(grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)], 33)
            values = self.criteria(grid)
        i = int(np.argmin(values))
        return 0.0 if zero <= values[i] or grid[i] < 1e-8 else float(grid[i])

    def degrees(self, theta: float, s2: float, se: float) -> float:
        """Satterthwaite: 2 v^2 over the variance of v = se^2 as a function of both variances."""
        if not theta > 0:
            return self.n - 2

        def full(par: np.ndarray) -> tuple[float, float]:
            """(-2 REML, variance of the slope) at (residual, intercept) variances."""
            value, _, c, own = self.at(par[1] / par[0])
            free = self.n - 2
            return value - free * np.log(own) + free * np.log(par[0]) + free * own / par[0], c[1, 1] / own * par[0]

        at = np.array([s2, theta * s2])
        h = 1e-4 * at
        hess, grad = np.zeros((2, 2)), np.zeros(2)
        for a in range(2):
            ea = h * (np.arange(2) == a)
            grad[a] = (full(at + ea)[1] - full(at - ea)[1]) / (2 * h[a])
            for b in range(2):
                eb = h * (np.arange(2) == b)
                hess[a, b] = (full(at + ea + eb)[0] - full(at + ea - eb)[0] - full(at - ea + eb)[0] + full(at - ea - eb)[0]) / (4 * h[a] * h[b])
        spread = float(grad @ (2 * np.linalg.pinv(hess)) @ grad)
        return 2 * se**4 / spread if spread > 0 else self.n - 2


def random_intercept(m: np.ndarray, sums: dict[str, np.ndarray]) -> dict:
    """Slope of y on x with an intercept a person: beta, se, df (Satterthwaite), t, p, interval, variances, singular."""
    model = Model(m, sums)
    n, persons = int(model.n), int(sums["persons"].sum())
    off = lambda xx, x: sums[xx].sum() - sums[x].sum() ** 2 / max(1, n)
    if n < 4 or persons < 2 or not (off("xx", "x") > 1e-9 * sums["xx"].sum() and off("yy", "y") > 1e-9 * sums["yy"].sum()):
        raise ValueError("too few rows or persons, or a constant variable")
    theta = model.best()
    _, beta, cov, s2 = model.at(theta)
    se = float(np.sqrt(cov[1, 1]))
    df, t = model.degrees(theta, s2, se), beta[1] / se
    p = beta_cdf(df / (df + t * t), df / 2, 0.5)
    return {"n": n, "persons": persons, "beta": beta[1], "se": se, "df": df, "t": t, "p": p, "ci_low": beta[1] - 1.96 * se, "ci_high": beta[1] + 1.96 * se, "var_person": theta * s2, "var_rest": s2, "singular": theta == 0.0}


MODEL = "n long, persons long, beta double, se double, df double, t double, p double, ci_low double, ci_high double, var_person double, var_rest double, singular boolean, error string"


def by_person(df: DataFrame, keys: list[str], y: str, x: str, person: str) -> DataFrame:
    """keys, person, m (rows) and the person's sums; rows without both values don't count. Values are centred by the caller."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    c, d = F.col(x), F.col(y)
    return ok.groupBy(*keys, person).agg(F.count("*").alias("m"), F.sum(c).alias("x"), F.sum(d).alias("y"), F.sum(c * c).alias("xx"), F.sum(c * d).alias("xy"), F.sum(d * d).alias("yy"))


def by_size(persons: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m and the sums by size of by_person's rows."""
    x, y = F.col("x"), F.col("y")
    return persons.groupBy(*keys, "m").agg(
        F.count("*").alias("persons"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(x * x).alias("px"), F.sum(x * y).alias("pxy"), F.sum(y * y).alias("py"),
        *[F.sum(c).alias(c) for c in ("xx", "xy", "yy")],
    )


def fit_sizes(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """The model of each key from the sums by size; a stratum that can't be fitted has its error."""
    # a model takes longer than its few rows tell, so the strata are dealt out by their number
    sizes = sizes.repartition(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema}
    names = [c.split()[0] for c in MODEL.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = {k: group[k].iloc[0] for k in keys}
        try:
            made = random_intercept(group["m"].to_numpy(float), {c: group[c].to_numpy(float) for c in SUMS}) | {"error": None}
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
            made = {"error": f"{type(e).__name__}: {e}"}
        out = pd.DataFrame([key | made], columns=[*keys, *names])
        return out.astype(object).where(out.notna(), None)

    return sizes.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + MODEL)


def fit(df: DataFrame, keys: list[str], y: str, x: str, person: str) -> DataFrame:
    return fit_sizes(by_size(by_person(df, keys, y, x, person), keys), keys)


def _placed(df: DataFrame, unit: list[str], person: str, value: str, sample: str, span: float | None):
    keys = [person, *[u for u in unit if u != person]]
    placed = series.numbered(df.where(F.col(value).isNotNull()), keys, sample, name="__n", span=span).withColumn("__p", F.col("__n") - 1)
    number = F.pmod(F.xxhash64(*keys), F.lit(halves.PRIME))
    return keys, placed, number


def random_half_sums(df: DataFrame, unit: list[str], person: str, value: str, sample: str, iterations: int, seed: int, span: float | None = None) -> DataFrame:
    """iteration and by_person's rows for the half means of every unit over keyed permutations (x even, y odd).

    Samples are numbered in the order of sample; span cuts long units by it, where it is a number.
    """
    keys, placed, number = _placed(df, unit, person, value, sample, span)
    made = halves.random_halves(placed, keys, number, value, "__p", iterations, seed)
    return by_person(made, ["iteration"], "odd_half_mean", "even_half_mean", person)


def random_half_sizes(df: DataFrame, unit: list[str], person: str, value: str, sample: str, iterations: int, seed: int, span: float | None = None) -> DataFrame:
    """iteration, m and the sums by size for the half means of every unit over keyed permutations (x even, y odd).

    Samples are numbered in the order of sample; span cuts long units by it, where it is a number. A unit's sums over all
    iterations are one row, persons are added up and dealt to sizes where these rows meet, so no row stands for a unit
    or person and an iteration.
    """
    keys, placed, number = _placed(df, unit, person, value, sample, span)
    sums = halves.half_sums(placed, keys, number, value, "__p", iterations, seed)
    sums = sums.select(F.col("__key")[person].alias("person"), "n", "total", "odd").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "person").sortWithinPartitions("person")
    names = ("x", "y", "px", "pxy", "py", "xx", "xy", "yy")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by size: persons and their sums over iterations; what a task holds grows with the sizes only
        sizes, now, m, own = {}, None, 0, None

        def close() -> None:
            x, y, xx, xy, yy = own
            found = sizes.setdefault(m, [0, np.zeros((len(names), iterations))])
            found[0] += 1
            found[1] += np.stack([x, y, x * x, x * y, y * y, xx, xy, yy])

        for batch in batches:
            persons, ns, totals = (batch.column(i).to_pylist() for i in range(3))
            odd = batch.column(3).flatten().to_numpy().reshape(len(persons), iterations)
            for who, n, total, o in zip(persons, ns, totals, odd):
                if own is None or who != now:
                    if own is not None:
                        close()
                    now, m, own = who, 0, np.zeros((5, iterations))
                even, odd_mean = (total - o) / (n // 2), o / (n - n // 2)
                m += 1
                own += np.stack([even, odd_mean, even * even, even * odd_mean, odd_mean * odd_mean])
        if own is not None:
            close()
        for size, (persons, found) in sizes.items():
            columns = [pa.array(np.arange(1, iterations + 1)), pa.array(np.full(iterations, size)), pa.array(np.full(iterations, persons)), *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(columns, ["iteration", "m", "persons", *names])

    made = sums.mapInArrow(folded, "iteration long, m long, persons long, " + ", ".join(f"{c} double" for c in names))
    return made.groupBy("iteration", "m").agg(*[F.sum(c).alias(c) for c in ("persons", *names)])


def spread(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, SD, median and the middle 95 % of beta over iterations."""
    q = F.percentile("beta", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = fits.where("error is null").groupBy(*keys).agg(F.count("beta").alias("n_fits"), F.avg("beta").alias("mean"), F.stddev_samp("beta").alias("sd"), q.alias("q"))
    return out.select(*keys, "n_fits", "mean", "sd", F.get("q", 1).alias("median"), F.get("q", 0).alias("low"), F.get("q", 2).alias("high"))
