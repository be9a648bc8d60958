"""Signal kernels on whole series by key, NumPy inside grouped pandas functions: spectra, phases, models.

Each group is one recording, trial or window. The kernels follow published methods; none depends on SciPy.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, keys: list[str], order: str, columns: list[str], kernel: Callable[..., dict | list[dict] | None], schema: str) -> DataFrame:
    """kernel(*arrays) of each key's columns in order; a dict a row, NaN as null; an error gives no row but its text.

    schema: of the kernel's results. The result has the keys, those columns, and error.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [c.split()[0] for c in schema.split(",")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = {k: group[k].iloc[0] for k in keys}
        group = group.sort_values(order)
        try:
            made = kernel(*[group[c].to_numpy(float) for c in columns])
            rows = [r | {"error": None} for r in ([made] if isinstance(made, dict) else made or [])]
        except (ValueError, ArithmeticError, np.linalg.LinAlgError, IndexError) as e:
            rows = [{"error": f"{type(e).__name__}: {e}"}]
        out = pd.DataFrame([key | r for r in rows], columns=[*keys, *names, "error"])
        return out.astype(object).where(out.notna(), None)

    full = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {schema}, error string"
    return df.select(*dict.fromkeys([*keys, order, *columns])).groupBy(*keys).applyInPandas(run, full)


def analytic(x: np.ndarray) -> np.ndarray:
    """x with its Hilbert transform as imaginary part."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def line_removed(x: np.ndarray) -> np.ndarray:
    """The residuals of x after a line; of a line itself exactly zero, not its rounding errors."""
    t = np.arange(len(x))
    rest = x - np.polyval(np.polyfit(t, x, 1), t) if len(x) > 1 else x - x
    return rest if rest.std() > 1e-9 * np.abs(x).max(initial=0.0) else np.zeros(len(x))


def standardised(x: np.ndarray) -> np.ndarray:
    sd = x.std()
    if not sd > 0:
        raise ValueError("a constant series")
    return (x - x.mean()) / sd


def phases(a: np.ndarray, b: np.ndarray, least: int = 10) -> dict:
    """Phase locking value, phase lag index, mean phase difference and envelope correlation."""
    ok = np.isfinite(a) & np.isfinite(b)
    a, b = a[ok], b[ok]
    if len(a) < least:
        return {"n": len(a), "plv": np.nan, "pli": np.nan, "mean_phase": np.nan, "envelope_r": np.nan}
    u, v = analytic(standardised(line_removed(a))), analytic(standardised(line_removed(b)))
    d = np.angle(u) - np.angle(v)
    mean = np.exp(1j * d).mean()
    return {"n": len(a), "plv": abs(mean), "pli": abs(np.sign(np.round(np.sin(d), 12)).mean()), "mean_phase": np.angle(mean), "envelope_r": np.corrcoef(abs(u), abs(v))[0, 1]}


def gathered(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys and each column's values in order as an array: a row a trial or window, which is bounded."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("__rows"))
    return rows.select(*keys, *[F.col("__rows")[c].alias(c) for c in columns])


def alike(a: pd.Series, b: pd.Series, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of series of one length and their values as matrices (a series a row), about most values at once."""
    sizes = a.map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, most // max(1, int(size)))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, *(np.array(list(x.to_numpy()[part]), float).reshape(len(part), size) for x in (a, b))


def line_of(x: Sequence[float], y: Sequence[float]) -> tuple[float, float]:
    """(slope, intercept) of y over x by running means, products added with one rounding: to the bit as DuckDB's."""
    mx = my = together = m = spread = sum_x = sum_y = 0.0
    for n, (u, v) in enumerate(zip(x, y), 1):
        dx, dy = u - mx, v - my
        mx, my = mx + dx / n, my + dy / n
        together = math.fma(dx, v - my, together)
        before, m = m, m + (u - m) / n
        spread = math.fma(u - m, u - before, spread)
        sum_x, sum_y = sum_x + u, sum_y + v
    slope = (together / n) / (spread / n) if spread else 0.0
    return slope, math.fma(-slope, sum_x / n, sum_y / n)


def phases_in_order(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(pli, mean_phase) of one pair by sums in the order of the series, as its SQL has them.

    Of opposite phases rounding alone tells pi from -pi, and near either which is ahead, so each step must round alike.
    """
    n = len(a)
    if n % 2 == 0:
        kernel = np.array([2.0 / n * (1 / math.tan(math.pi * m / n)) if m % 2 else 0.0 for m in range(n)])
    else:
        kernel = np.array([0.0, *((1 / math.tan(math.pi * m / n) - math.cos(math.pi * m) / math.sin(math.pi * m / n)) / n for m in range(1, n))])
    angles = []
    for x in (a, b):
        slope, base = line_of(range(n), x.tolist())
        rest = (x - base) - slope * np.arange(n)
        turned = np.zeros(n)
        for j in range(n):
            turned += rest[j] * kernel[np.arange(-j, n - j) % n]
        angles.append([math.atan2(u, v) for u, v in zip(turned, rest)])
    d = [u - v for u, v in zip(*angles)]
    total = lambda f: functools.reduce(lambda s, x: s + f(x), d, 0.0) / n
    pli = abs(total(lambda x: float(np.sign(round(math.sin(x), 12)))))
    return pli, math.atan2(total(math.sin), total(math.cos))


def many_phases(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """phases of many pairs of one length (a pair a row): plv, pli, mean_phase, envelope_r; NaN where a series is but a line."""
    plain = a, b
    t = np.arange(a.shape[1]) - (a.shape[1] - 1) / 2

    def prepared(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = x - x.mean(axis=1, keepdims=True)
        rest = rest - (rest @ t / (t @ t))[:, None] * t
        sd = rest.std(axis=1)
        bent = sd > 1e-9 * np.abs(x).max(axis=1)
        return bent, (rest - rest.mean(axis=1, keepdims=True)) / np.where(bent, sd, 1.0)[:, None]

    n = a.shape[1]
    gain = np.zeros(n)
    gain[0], gain[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0:
        gain[n // 2] = 1
    (bent_a, a), (bent_b, b) = prepared(a), prepared(b)
    u, v = (np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1) for x in (a, b))
    d = np.angle(u) - np.angle(v)
    mean = np.exp(1j * d).mean(axis=1)
    p, q = (abs(x) - abs(x).mean(axis=1, keepdims=True) for x in (u, v))
    spread = np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (p * q).sum(axis=1) / spread
    out = np.stack([abs(mean), abs(np.sign(np.round(np.sin(d), 12)).mean(axis=1)), np.angle(mean), r], axis=1)
    for i in np.flatnonzero(bent_a & bent_b & (np.abs(np.sin(d)).min(axis=1) < 1e-9)):
        pli, phase = phases_in_order(plain[0][i], plain[1][i])
        out[i, 1:3] = pli, phase if abs(mean[i].imag) < 1e-9 else out[i, 2]
    out[~(bent_a & bent_b)] = np.nan
    return out


def phases_by_key(df: DataFrame, keys: list[str], order: str, least: int = 10) -> DataFrame:
    """keys, n, plv, pli, mean_phase, envelope_r of the trials with at least so many samples of both, none of them but a line.

    Trials of one length are transformed together.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    @F.pandas_udf("plv double, pli double, mean_phase double, envelope_r double")
    def made(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = np.empty((len(a), 4))
        for at, x, y in alike(a, b):
            out[at] = many_phases(x, y)
        return pd.DataFrame(out, columns=["plv", "pli", "mean_phase", "envelope_r"])

    rows = gathered(df.where(known("a") & known("b")), keys, order, ["a", "b"]).withColumn("n", F.size("a").cast("long")).where(F.col("n") >= least)
    names = ("plv", "pli", "mean_phase", "envelope_r")
    out = rows.select(*keys, "n", made("a", "b").alias("__p")).select(*keys, "n", *[F.nanvl(F.col("__p")[c], F.lit(None).cast("double")).alias(c) for c in names])
    return out.where("plv is not null")


def welch(x: np.ndarray, y: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and averaged one-sided cross-spectrum: Hann window, half overlap, each part's mean removed."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, len(x) - size + 1, max(1, size - size // 2))
    cut = lambda s: np.fft.rfft(np.stack([(s[a : a + size] - s[a : a + size].mean()) * window for a in starts]), axis=1)
    power = (np.conj(cut(x)) * cut(y)).mean(axis=0) / (fs * (window**2).sum())
    power[1 : len(power) - (size % 2 == 0)] *= 2
    return np.fft.rfftfreq(size, 1 / fs), power


def coherence(a: np.ndarray, b: np.ndarray, fs: float, low: float = 0.04, high: float = 0.40, least: int = 256) -> dict:
    """Mean, largest and place of the largest magnitude-squared coherence within a band."""
    ok = np.isfinite(a) & np.isfinite(b)
    a, b = a[ok], b[ok]
    none = {"n": len(a), "mean_coherence": np.nan, "max_coherence": np.nan, "at_frequency": np.nan}
    size = min(256, len(a) // 4)
    if len(a) < least or size < 16:
        return none
    f, ab = welch(a, b, fs, size)
    _, aa = welch(a, a, fs, size)
    _, bb = welch(b, b, fs, size)
    band = (f >= low) & (f <= high) & (aa.real * bb.real > 0)
    if not band.any():
        return none
    c = (abs(ab) ** 2)[band] / (aa.real * bb.real)[band]
    return {"n": len(a), "mean_coherence": c.mean(), "max_coherence": c.max(), "at_frequency": f[band][c.argmax()]}


# ---- distributions


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    from math import exp, lgamma, log, log1p

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + k * d, tiny) if 1 + k * d >= 0 else 1 / min(1 + k * d, -tiny)
        c = 1 + k / c or tiny
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


def t_test_p(r: float, n: int) -> float:
    """Two-sided p of a correlation."""
    if n < 3 or not abs(r) < 1 - 1e-14:
        return 0.0 if abs(r) < 1 + 1e-9 and n > 2 else float("nan")
    t2 = r * r * (n - 2) / (1 - r * r)
    return beta_cdf((n - 2) / (n - 2 + t2), (n - 2) / 2, 0.5)


def t_test_ps(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """t_test_p of arrays: one continued fraction for all, as long as the slowest of them needs."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    out = np.where((n > 2) & (np.abs(r) < 1 + 1e-9), 0.0, np.nan)
    open_ = (n >= 3) & (np.abs(r) < 1 - 1e-14)
    r, n = r[open_], n[open_]
    if not len(r):
        return out
    # the smaller part of the beta function's area: p, or what p lacks of 1
    p_side = (1 - r * r) <= ((n - 2) / 2 + 1) / ((n - 1) / 2 + 2)
    half = np.full(len(r), 0.5)
    x, a, b = np.where(p_side, 1 - r * r, r * r), np.where(p_side, (n - 2) / 2, half), np.where(p_side, half, (n - 2) / 2)
    each, where = np.unique(n, return_inverse=True)
    size = np.array([math.lgamma((m - 1) / 2) - math.lgamma((m - 2) / 2) - math.lgamma(0.5) for m in each])[where]
    with np.errstate(divide="ignore"):
        front = np.exp(size + a * np.log(x) + b * np.log1p(-x)) / a
    kept = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d, made, i = np.ones(len(r)), np.zeros(len(r)), np.ones(len(r)), 0
    while i < 100_000:
        m = i // 2
        if i == 0:
            k = np.ones(len(r))
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / kept(1 + k * d)
        c = kept(1 + k / c)
        made = made * c * d
        i += 1
        if (np.abs(1 - c * d) < 1e-14).all():
            break
    part = front * (made - 1)
    out[open_] = np.where(p_side, part, 1 - part)
    return out


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of correlations, null where there is none."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(t_test_ps(r.astype(float).to_numpy(), n.fillna(0).to_numpy()))

    return F.nanvl(p(r, n), F.lit(None).cast("double"))


def f_test_p(f: float, d1: int, d2: int) -> float:
    return 1 - beta_cdf(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2) if f > 0 else 1.0


def granger(a: np.ndarray, b: np.ndarray, most: int = 5) -> dict:
    """Least p over lags 1 to most of the F test that one series' past helps predict the other, both ways."""

    def test(cause: np.ndarray, effect: np.ndarray, k: int) -> float:
        n = len(effect) - k
        past = lambda s: np.stack([s[k - j - 1 : len(s) - j - 1] for j in range(k)], axis=1)
        y, one = effect[k:], np.ones((n, 1))
        rest = []
        for x in (np.hstack([one, past(effect)]), np.hstack([one, past(effect), past(cause)])):
            rest.append(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
        free = n - 2 * k - 1
        return f_test_p((rest[0] - rest[1]) / k / (rest[1] / free), k, free)

    if len(a) <= 3 * most + 2:
        return {"p_ab": np.nan, "p_ba": np.nan, "direction": "unavailable"}
    a, b = standardised(a), standardised(b)
    ab, ba = (min(test(x, y, k) for k in range(1, most + 1)) for x, y in ((a, b), (b, a)))
    return {"p_ab": ab, "p_ba": ba, "direction": "both" if max(ab, ba) < 0.05 else "A" if ab < 0.05 else "B" if ba < 0.05 else "none"}


def beta_cdfs(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """beta_cdf of arrays: one continued fraction for all, as long as the slowest of them needs."""
    x = np.clip(x, 0.0, 1.0)
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    each, where = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
    size = np.array([math.lgamma(u + v) - math.lgamma(u) - math.lgamma(v) for u, v in each.T])[where.ravel()]
    with np.errstate(divide="ignore"):
        front = np.exp(size + a * np.log(x) + b * np.log1p(-x)) / a
    kept = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d, out = np.ones(len(x)), np.zeros(len(x)), np.ones(len(x))
    for i in range(400):
        m = i // 2
        if i == 0:
            k = np.ones(len(x))
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / kept(1 + k * d)
        c = kept(1 + k / c)
        out = out * c * d
        if (np.abs(1 - c * d) < 1e-14).all():
            break
    part = front * (out - 1)
    return np.where(turned, 1 - part, part)


def many_granger(a: np.ndarray, b: np.ndarray, most: int = 5) -> np.ndarray:
    """p_ab and p_ba of granger of many pairs of one length (a pair a row), none of them constant; NaN where they are short.

    One QR factorisation gives both models, as the terms of the lesser one come first. Terms that hang on each other but for
    rounding are left to least squares of one pair.
    """
    out = np.full((len(a), 2), np.nan)
    size = a.shape[1]
    if size <= 3 * most + 2 or not len(a):
        return out
    plain = a, b
    a, b = ((x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True) for x in (a, b))
    ps, clear = [], np.ones(len(a), bool)
    for cause, effect in ((a, b), (b, a)):
        for k in range(1, most + 1):
            past = [x[:, k - j - 1 : size - j - 1] for x in (effect, cause) for j in range(k)]
            y = effect[:, k:]
            q, r = np.linalg.qr(np.stack([np.ones(y.shape), *past], axis=2))
            scale = np.abs(np.diagonal(r, axis1=1, axis2=2))
            clear &= scale.min(axis=1) > 1e-9 * scale.max(axis=1)
            # what is left of y is taken off it, not off its square
            rest = y - (q[:, :, : k + 1] @ (np.swapaxes(q[:, :, : k + 1], 1, 2) @ y[:, :, None]))[:, :, 0]
            less = (rest * rest).sum(axis=1)
            rest = rest - (q[:, :, k + 1 :] @ (np.swapaxes(q[:, :, k + 1 :], 1, 2) @ rest[:, :, None]))[:, :, 0]
            full, free = (rest * rest).sum(axis=1), size - k - 2 * k - 1
            clear &= full > 1e-18 * size
            f = np.maximum((less - full) / k / (np.where(clear, full, 1.0) / free), 0.0)
            ps.append(1 - beta_cdfs(k * f / (k * f + free), np.full(len(f), k / 2), np.full(len(f), free / 2)))
    out[:] = np.stack([np.min(ps[:most], axis=0), np.min(ps[most:], axis=0)], axis=1)
    for i in np.flatnonzero(~clear):
        made = granger(plain[0][i], plain[1][i], most)
        out[i] = made["p_ab"], made["p_ba"]
    return out


def cross_recurrence(a: np.ndarray, b: np.ndarray, dim: int = 3, delay: int = 1, radius: float = 0.1, least: int = 50) -> dict:
    """Recurrence rate, determinism, mean, longest and entropy of diagonals, laminarity and trapping time of verticals."""
    none = dict.fromkeys(("rr", "det", "l_mean", "l_max", "entropy", "lam", "tt"), np.nan)
    if len(a) < least:
        return none
    a, b = standardised(a), standardised(b)
    n = len(a) - delay * (dim - 1)
    e = lambda s: np.stack([s[j * delay : j * delay + n] for j in range(dim)], axis=1)
    ea, eb = e(a), e(b)

    def lengths(lines: list[np.ndarray]) -> np.ndarray:
        """The lengths of the stretches of truths in the lines."""
        x = np.concatenate([np.concatenate((line, [False])) for line in lines]).astype(np.int8)
        d = np.diff(x, prepend=0)
        return np.flatnonzero(d == -1) - np.flatnonzero(d == 1)

    # the n x n picture is never held: a line of it at a time, along diagonals and then along columns
    close = lambda x, y: ((x - y) ** 2).sum(axis=1) <= radius**2
    diagonal = lengths([close(ea[max(0, -k) : n - max(0, k)], eb[max(0, k) : n + min(0, k)]) for k in range(1 - n, n)])
    vertical = lengths([close(ea, eb[j]) for j in range(n)])
    total = int(vertical.sum())
    if not total:
        return none | {"rr": 0.0}
    d, v = diagonal[diagonal >= 2], vertical[vertical >= 2]
    p = np.bincount(d)[2:] / len(d) if len(d) else np.zeros(0)
    p = p[p > 0]
    return {"rr": total / n**2, "det": d.sum() / total, "l_mean": d.mean() if len(d) else 0.0, "l_max": float(d.max()) if len(d) else 0.0, "entropy": float(-(p * np.log(p)).sum()), "lam": v.sum() / total, "tt": v.mean() if len(v) else 0.0}
