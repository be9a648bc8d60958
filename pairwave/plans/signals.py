"""Queries on phases, spectra, surrogates, models and ECG: grouped pandas kernels on whole series or trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import dependence, ecg, mixed, scan, series, signal, spectra, summary, synchrony, transfer, trial
from ..operators.storage import cut
from .standin import DYADS, GRID, SAMPLES, blocks_of, dyads, r_sql, readings, samples
from .timeseries import LAGS, PHASES


def _r(*names: str, digits: int = 6):
    return [rounded(F.col(n), digits).alias(n) for n in names]


def phase_metrics(spark, sf):
    """Phase locking, phase lag index and envelope correlation of each trial of a dyad."""
    out = signal.phases_by_key(dyads(spark, sf), ["dyad", "trial"], "k")
    return out.select("dyad", F.col("trial").cast("long").alias("trial"), "n", *_r("plv", "pli", "mean_phase", "envelope_r"))


def coherence(spark, sf):
    """Coherence over whole dyads, on a scale where the hourly grid is 4 Hz."""
    out = spectra.coherence(dyads(spark, sf), ["dyad"], "k", 4.0)
    return out.select("dyad", "n", *_r("mean_coherence", "max_coherence", "at_frequency"))


def _intervals(spark, sf):
    """Each sensor's intervals, minutes between events as milliseconds, at the running sum of them in seconds."""
    rr = series.intervals(readings(spark, sf), ["sensor"]).select("sensor", "start", "interval_number", (F.col("rr_ms") / 3600.0).alias("rr"))
    rr = scan.running(scan.pieces(cut(rr), ["sensor"], "start"), ["start"], "at", F.col("rr")).drop(scan.PIECE)
    return rr.withColumn("at", F.col("at") / 1000)


def rr_spectrum(spark, sf):
    """LF and HF power in square seconds."""
    out = spectra.band_powers(_intervals(spark, sf), ["sensor"], "at", "rr")
    out = out.withColumn("lf", F.col("lf") / 1e6).withColumn("hf", F.col("hf") / 1e6)
    return out.select("sensor", "n", *_r("lf", "hf", "lf_hf", digits=4))


def granger(spark, sf):
    out = dependence.granger(dyads(spark, sf), ["dyad"], "k")
    return out.select("dyad", *_r("p_ab", "p_ba"), "direction", "error")


def cross_recurrence(spark, sf):
    out = dependence.recurrence_of(blocks_of(spark, sf, 168, "week"))
    return out.select("dyad", "week", "n", *_r("rr", "det", "l_mean", "l_max", "entropy", "lam", "tt"))


def correlation_p(spark, sf):
    """Pearson's r and Spearman's rho of trials with their two-sided p."""
    out = synchrony.spearman(dyads(spark, sf), ["dyad", "trial"], plain="r")
    p = lambda c: rounded(signal.correlation_p(F.col(c), F.col("n")), 5)
    return out.select("dyad", F.col("trial").cast("long").alias("trial"), "n", *_r("r", "rho"), p("r").alias("p"), p("rho").alias("rho_p"))


def surrogates(spark, sf):
    """Transfer entropy of dyads against 400 permutations, lags 1 to 13, both ways and their difference.

    Windows are those of the reference, 120 samples of which 80 % are the next window's, on the hourly grid.
    """
    out = transfer.ste_windows(dyads(spark, sf), ["dyad"], "t", 3600.0)
    names = [n for x in transfer.NULLS for n in (x, f"{x}_mean", f"{x}_sd", f"{x}_z", f"{x}_p")]
    return out.select("dyad", F.col("run").cast("long").alias("run"), F.col("window").cast("long").alias("win"), "start", "end", "centre", "tau", "delta", "n_symbols", "few_symbols", *_r("bias_ba", "bias_ab", *names))


def _halves(spark, sf):
    """The samples of units (a sensor's kind of event) of persons, about 100 so that sums of squares keep their digits."""
    s = samples(spark, sf).withColumn("person", F.floor(F.col("sensor") / 2).cast("long"))
    return s.withColumn("x", F.col("x") - 100.0)


def mixed_model(spark, sf):
    """Odd on even half means with an intercept a person."""
    halves = summary.split_halves(_halves(spark, sf), ["person", "sensor", "event_type"], "x", F.col("n")).withColumn("stratum", F.lit("all"))
    fits = mixed.fit(halves, ["stratum"], "odd_half_mean", "even_half_mean", "person")
    return fits.select("stratum", "n", "persons", *_r("beta", "se", "df", "t", "p", "ci_low", "ci_high", digits=4), "singular", "error")


def split_spread(spark, sf):
    """Slopes over 1000 random splits: mean, SD, median and their middle 95 %."""
    sums = mixed.random_half_sizes(_halves(spark, sf), ["sensor", "event_type"], "person", "x", "event_id", 1000, 448, span=100_000)
    fits = mixed.fit_sizes(sums, ["iteration"])
    return mixed.spread(fits.withColumn("stratum", F.lit("all")), ["stratum"]).select("stratum", "n_fits", *_r("mean", "sd", "median", "low", "high"))


#: Samples a second of the hourly grid when it is read as an ECG.
FS = 32.0


def _recordings(spark, sf):
    """Each sensor's hourly grid as a recording."""
    return series.to_grid(readings(spark, sf), ["sensor"], 3600.0, tie="event_id").select("sensor", "t", "x")


def ecg_peaks(spark, sf):
    """The peaks that are found in each sensor's recording."""
    rows = ecg.cut(ecg.placed(_recordings(spark, sf), ["sensor"], span=30 * 86400.0))
    found = ecg.peaks(ecg.complexes(ecg.steepness(rows, ["sensor"], FS), ["sensor"]), ["sensor"], FS)
    return found.select("sensor", "place", *_r("height", digits=3))


def ecg_recordings(spark, sf):
    """A row a recording: peaks found and left, what was corrected, and the gain of cleaning."""
    _, told = ecg.recordings(_recordings(spark, sf), ["sensor"], FS)
    return told.select("sensor", "samples", "n_raw", "n_fixed", "extra", "missed", "shifted", *_r("gain_db"))


_TRIAL = {"most_lag": 10, "width": 24 * 3600.0, "step": 12 * 3600.0}
_PLAIN = (
    "duration", "mean_a", "sd_a", "min_a", "max_a", "mean_rr_a", "sd_rr_a", "mean_b", "sd_b", "min_b", "max_b", "mean_rr_b", "sd_rr_b", "mean_dyad", "mean_diff",
    "sd_diff", "rr_bias", "rr_bias_sd", "pearson_r", "spearman_r", "peak_r", "r_ab", "r_ba", "asymmetry", "window_r_mean", "window_r_sd", "window_r_min", "window_r_max",
)


def trial_metrics(spark, sf):
    """A row a trial with the metrics that SQL can check."""
    out = trial.plain_of(blocks_of(spark, sf), **_TRIAL)
    return out.select("dyad", "trial", "status", "error", "n", F.col("lag").cast("long").alias("lag"), "lag_one_leader", "n_windows", *_r(*_PLAIN))


def trial_assembly(spark, sf):
    """A row a trial with all metrics, phases, spectra, causes, recurrence, p values and the leader's vote among them."""
    out = trial.metrics_of(blocks_of(spark, sf), fs=4.0, seconds=3600.0, **_TRIAL)
    numbers = [f.name for f in out.schema if f.dataType.simpleString() == "double"]
    return out.select("dyad", "trial", "status", "error", "kernel_error", "n", "lag", "lag_one_leader", "n_windows", "leader", *_r(*numbers))


def variability(spark, sf):
    """Heart-rate variability of each sensor."""
    out = trial.variability(_intervals(spark, sf), ["sensor"], "interval_number", "rr", "at")
    return out.select("sensor", "n", "status", *_r("mean_nn", "sdnn", "rmssd", "pnn50", "lf", "hf", "lf_hf", "sd1", "sd2", "sd_ratio", digits=4))


NAMES = (
    phase_metrics, coherence, rr_spectrum, granger, cross_recurrence, correlation_p, surrogates, mixed_model, split_spread,
    ecg_peaks, ecg_recordings, trial_metrics, trial_assembly, variability,
)
QUERIES = {f.__name__: f for f in NAMES}

_SHAPES = ", ".join(
    f"avg({x}) AS mean_{x}, stddev_samp({x}) AS sd_{x}, min({x}) AS min_{x}, max({x}) AS max_{x}, avg(60000 / {x}) AS mean_rr_{x}, stddev_samp(60000 / {x}) AS sd_rr_{x}" for x in "ab"
)


def _p_sql(r: str) -> str:
    """Two-sided p of a correlation of n values: Student's distribution of n - 2 degrees as a finite sum of powers of a cosine."""
    powers = f"pow(1 - {r} * {r}, k)"
    even = f"abs({r}) * coalesce(list_sum(list_transform(generate_series(0, (n - 4) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * {powers})), 0)"
    odd = f"coalesce(list_sum(list_transform(generate_series(0, (n - 5) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * {powers})), 0)"
    odd = f"2 / pi() * (asin(least(abs({r}), 1)) + abs({r}) * sqrt(greatest(1 - {r} * {r}, 0)) * CASE WHEN n < 5 THEN 0 ELSE {odd} END)"
    return f"CASE WHEN abs({r}) >= 1 - 1e-14 THEN 0 ELSE round(1 - CASE WHEN n % 2 = 0 THEN {even} ELSE {odd} END, 5) + 0.0::DOUBLE END"


ORACLES = {
    "correlation_p": f"""WITH {DYADS}, k AS (SELECT dyad, trial, a, b, rank() OVER (PARTITION BY dyad, trial ORDER BY a) + (count(*) OVER (PARTITION BY dyad, trial, a) - 1) / 2 AS ra,
          rank() OVER (PARTITION BY dyad, trial ORDER BY b) + (count(*) OVER (PARTITION BY dyad, trial, b) - 1) / 2 AS rb FROM dyads),
        c AS (SELECT dyad, trial, count(*) AS n, {r_sql("a", "b")} AS r, {r_sql("ra", "rb")} AS rho FROM k GROUP BY ALL)
        SELECT dyad, trial, n, round(r, 6) + 0.0::DOUBLE AS r, round(rho, 6) + 0.0::DOUBLE AS rho, {_p_sql("r")} AS p, {_p_sql("rho")} AS rho_p FROM c""",
    "phase_metrics": f"""WITH {PHASES}
        SELECT dyad, trial, any_value(n) AS n, round(sqrt(avg(cos(d)) ** 2 + avg(sin(d)) ** 2), 6) AS plv, round(abs(avg(sign(round(sin(d), 12)))), 6) AS pli,
               round(atan2(avg(sin(d)), avg(cos(d))), 6) + 0.0::DOUBLE AS mean_phase, round(covar_samp(ea, eb) / (stddev_samp(ea) * stddev_samp(eb)), 6) AS envelope_r FROM d GROUP BY dyad, trial""",
    # Welch's method as sums of cosines and sines over the parts; scales cancel in the coherence
    "coherence": f"""WITH {DYADS}, p AS (SELECT dyad, row_number() OVER (PARTITION BY dyad ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY dyad) AS n, a, b FROM dyads),
        s AS (SELECT DISTINCT dyad, n, least(256, n // 4) AS size FROM p), g AS (SELECT dyad, size, unnest(generate_series(0, n - size, size - size // 2)) AS st FROM s WHERE n >= 256 AND size >= 16),
        part AS (SELECT g.dyad, size, st, i - st AS j, (a - avg(a) OVER w) * h AS a, (b - avg(b) OVER w) * h AS b FROM g JOIN p ON p.dyad = g.dyad AND p.i BETWEEN st AND st + size - 1,
          LATERAL (SELECT 0.5 - 0.5 * cos(2 * pi() * (i - st) / size) AS h) WINDOW w AS (PARTITION BY g.dyad, st)),
        f AS (SELECT dyad, size, st, q, sum(a * cos(z)) AS ar, -sum(a * sin(z)) AS ai, sum(b * cos(z)) AS br, -sum(b * sin(z)) AS bi FROM (
          SELECT part.*, q, 2 * pi() * q * j / size AS z FROM part, range(0, 129) AS r(q) WHERE q * 4.0 / size BETWEEN 0.04 AND 0.40) GROUP BY ALL),
        c AS (SELECT dyad, size, q, (sum(ar * br + ai * bi) ** 2 + sum(ar * bi - ai * br) ** 2) / (sum(ar * ar + ai * ai) * sum(br * br + bi * bi)) AS c FROM f GROUP BY ALL),
        m AS (SELECT dyad, avg(c) AS mean, max(c) AS top, arg_max(q * 4.0::DOUBLE / size, c) AS freq FROM c GROUP BY dyad)
        SELECT s.dyad, n, round(mean, 6) AS mean_coherence, round(top, 6) AS max_coherence, round(freq, 6) AS at_frequency FROM s LEFT JOIN m ON m.dyad = s.dyad""",
    "rr_spectrum": f"""WITH {SAMPLES}, iv AS (SELECT sensor, t, (lead(t) OVER (PARTITION BY sensor ORDER BY t) - t) * 1000 / 3600 AS rr FROM samples),
        pt AS (SELECT sensor, row_number() OVER w AS m, rr, sum(rr) OVER w / 1000 AS sec FROM iv WHERE rr > 0 WINDOW w AS (PARTITION BY sensor ORDER BY t)),
        st AS (SELECT sensor, sec AS t0, rr AS x0, lead(sec) OVER w AS t1, lead(rr) OVER w AS x1, first_value(sec) OVER w AS a0 FROM pt WINDOW w AS (PARTITION BY sensor ORDER BY m)),
        gr AS (SELECT sensor, i, a0 + i * 0.25::DOUBLE AS t, t0, x0, t1, x1 FROM (SELECT *, unnest(generate_series(ceil((t0 - a0) * 4)::BIGINT, ceil((t1 - a0) * 4)::BIGINT - 1)) AS i FROM st WHERE t1 IS NOT NULL)),
        v AS (SELECT sensor, i, count(*) OVER (PARTITION BY sensor) AS n, x0 + (t - t0) * (x1 - x0) / (t1 - t0) AS x FROM gr),
        l AS (SELECT sensor, regr_slope(x, i) AS b, regr_intercept(x, i) AS a FROM v GROUP BY sensor), d AS (SELECT sensor, i, n, x - a - b * i AS x FROM v JOIN l USING (sensor) WHERE n >= 8),
        g AS (SELECT sensor, size, unnest(generate_series(0, n - size, greatest(1, size - size // 2))) AS st FROM (SELECT DISTINCT sensor, n, least(256, n) AS size FROM d)),
        part AS (SELECT g.sensor, size, st, i - st AS j, (x - avg(x) OVER w) * h AS x, h FROM g JOIN d ON d.sensor = g.sensor AND d.i BETWEEN st AND st + size - 1,
          LATERAL (SELECT 0.5 - 0.5 * cos(2 * pi() * (i - st) / size) AS h) WINDOW w AS (PARTITION BY g.sensor, st)),
        f AS (SELECT sensor, size, st, q, sum(x * cos(z)) ** 2 + sum(x * sin(z)) ** 2 AS s, sum(h * h) AS hh FROM (
          SELECT part.*, q, 2 * pi() * q * j / size AS z FROM part, range(0, 129) AS r(q) WHERE q * 4.0 / size >= 0.04 AND q * 4.0 / size < 0.40) GROUP BY ALL),
        c AS (SELECT sensor, size, q, q * 4.0::DOUBLE / size AS f, 2 * avg(s) / (4 * any_value(hh)) AS p FROM f GROUP BY ALL),
        e AS (SELECT sensor, f, p, lead(f) OVER w AS f1, lead(p) OVER w AS p1 FROM c WINDOW w AS (PARTITION BY sensor ORDER BY q)),
        m AS (SELECT sensor, coalesce(sum((p + p1) / 2 * (f1 - f)) FILTER (f1 < 0.15), 0) AS lf, coalesce(sum((p + p1) / 2 * (f1 - f)) FILTER (f >= 0.15), 0) AS hf FROM e GROUP BY sensor),
        n AS (SELECT sensor, max(n) AS n FROM v GROUP BY sensor)
        SELECT n.sensor, n, round(lf / 1e6, 4) AS lf, round(hf / 1e6, 4) AS hf, round(lf / hf, 4) AS lf_hf FROM n LEFT JOIN m ON m.sensor = n.sensor""",
    # points of three neighbours at most 0.1 apart, and how far lines of them go along i - j and along i
    "cross_recurrence": f"""WITH {DYADS}, w AS (SELECT dyad, k // 168 AS week, k, a, b FROM dyads),
        z AS (SELECT dyad, week, row_number() OVER (PARTITION BY dyad, week ORDER BY k) AS i, count(*) OVER v AS n,
          (a - avg(a) OVER v) / stddev_pop(a) OVER v AS a, (b - avg(b) OVER v) / stddev_pop(b) OVER v AS b FROM w WINDOW v AS (PARTITION BY dyad, week)),
        e AS (SELECT *, lead(a) OVER v AS a1, lead(a, 2) OVER v AS a2, lead(b) OVER v AS b1, lead(b, 2) OVER v AS b2 FROM z WINDOW v AS (PARTITION BY dyad, week ORDER BY i)),
        r AS (SELECT x.dyad, x.week, x.i, y.i AS j FROM e x JOIN e y USING (dyad, week) WHERE x.n >= 50 AND x.a2 IS NOT NULL AND y.b2 IS NOT NULL
          AND (x.a - y.b) ** 2 + (x.a1 - y.b1) ** 2 + (x.a2 - y.b2) ** 2 <= 0.1 ** 2),
        dl AS (SELECT dyad, week, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY dyad, week, j - i ORDER BY i) AS g FROM r) GROUP BY dyad, week, j - i, g),
        vl AS (SELECT dyad, week, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY dyad, week, j ORDER BY i) AS g FROM r) GROUP BY dyad, week, j, g),
        d AS (SELECT dyad, week, sum(len) FILTER (len > 1) AS points, count(*) FILTER (len > 1) AS lines, max(len) FILTER (len > 1) AS top FROM dl GROUP BY ALL),
        h AS (SELECT dyad, week, -sum(p * ln(p)) AS entropy FROM (SELECT dyad, week, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY dyad, week) AS p FROM dl WHERE len > 1 GROUP BY dyad, week, len) GROUP BY ALL),
        v AS (SELECT dyad, week, sum(len) AS total, sum(len) FILTER (len > 1) AS points, count(*) FILTER (len > 1) AS lines FROM vl GROUP BY ALL),
        s AS (SELECT dyad, week, count(*) AS n FROM w GROUP BY ALL)
        SELECT s.dyad, s.week, n, CASE WHEN n >= 50 THEN round(coalesce(total, 0) / (n - 2) ** 2, 6) END AS rr, round(coalesce(d.points, 0) / total, 6) AS det,
          CASE WHEN total > 0 THEN round(coalesce(d.points / d.lines, 0), 6) END AS l_mean, CASE WHEN total > 0 THEN round(coalesce(top, 0)::DOUBLE, 6) END AS l_max,
          CASE WHEN total > 0 THEN round(coalesce(entropy, 0), 6) + 0.0::DOUBLE END AS entropy, round(coalesce(v.points, 0) / total, 6) AS lam, round(v.points / v.lines, 6) AS tt
        FROM s LEFT JOIN d USING (dyad, week) LEFT JOIN h USING (dyad, week) LEFT JOIN v USING (dyad, week)""",
    # FS of 32: means of 65, 3 and 24 samples; peaks less than 9.6 samples apart are gone through in order
    "ecg_peaks": f"""WITH {GRID}, s AS (SELECT sensor, row_number() OVER (PARTITION BY sensor ORDER BY k) - 1 AS i, x FROM grid),
        c AS (SELECT sensor, i, round(x - avg(x) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING), 9) AS c FROM s),
        g AS (SELECT sensor, i, c, abs(coalesce(lead(c) OVER w, c) - coalesce(lag(c) OVER w, c)) / CASE WHEN lag(c) OVER w IS NULL OR lead(c) OVER w IS NULL THEN 1 ELSE 2 END AS steep FROM c
          WINDOW w AS (PARTITION BY sensor ORDER BY i)),
        n AS (SELECT sensor, i, c, avg(steep) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
          > 1.5 * avg(steep) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS inside FROM g),
        r AS (SELECT sensor, i, c, inside, sum(CASE WHEN inside AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY sensor ORDER BY i) AS r FROM (
          SELECT *, coalesce(lag(inside) OVER (PARTITION BY sensor ORDER BY i), false) AS was FROM n)),
        top AS (SELECT sensor, r, i AS place, c AS height, count(*) OVER (PARTITION BY sensor, r) AS n FROM r WHERE inside
          QUALIFY row_number() OVER (PARTITION BY sensor, r ORDER BY c DESC, i) = 1),
        long AS (SELECT * FROM (SELECT *, avg(n) OVER (PARTITION BY sensor) AS m FROM top) WHERE n >= 0.4 * m),
        close AS (SELECT *, sum(CASE WHEN place - was <= 9.6 THEN 0 ELSE 1 END) OVER (PARTITION BY sensor ORDER BY place) AS grp FROM (
          SELECT *, lag(place) OVER (PARTITION BY sensor ORDER BY place) AS was FROM long)),
        lists AS (SELECT sensor, list([{{'p': place, 'h': height}}] ORDER BY place) AS l FROM close GROUP BY sensor, grp),
        kept AS (SELECT sensor, unnest(list_reduce(l, lambda a, x: CASE WHEN x[1].p - a[len(a)].p > 9.6 THEN list_concat(a, x)
          WHEN x[1].h > a[len(a)].h THEN list_concat(a[1 : len(a) - 1], x) ELSE a END)) AS e FROM lists)
        SELECT sensor, e.p AS place, round(e.h, 3) + 0.0::DOUBLE AS height FROM kept""",
    "trial_metrics": f"""WITH {LAGS.replace("KEY", "trial")},
        base AS (SELECT dyad, trial, count(*) AS n, max(t) - min(t) AS duration, {_SHAPES}, avg((a + b) / 2) AS mean_dyad, avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd_diff,
          avg(60000 / a - 60000 / b) AS rr_bias, stddev_samp(60000 / a - 60000 / b) AS rr_bias_sd FROM dyads GROUP BY ALL),
        line AS (SELECT dyad, trial, regr_slope(a, k % 48) AS sa, regr_intercept(a, k % 48) AS ia, regr_slope(b, k % 48) AS sb, regr_intercept(b, k % 48) AS ib FROM dyads GROUP BY ALL),
        rest AS (SELECT dyad, trial, a, b, a - ia - sa * (k % 48) AS ra, b - ib - sb * (k % 48) AS rb FROM dyads JOIN line USING (dyad, trial)),
        linear AS (SELECT dyad, trial, {r_sql("ra", "rb")} AS pearson_r FROM rest GROUP BY ALL HAVING stddev_pop(ra) > 1e-9 * max(abs(a)) AND stddev_pop(rb) > 1e-9 * max(abs(b))),
        ranked AS (SELECT dyad, trial, rank() OVER (PARTITION BY dyad, trial ORDER BY ra) AS qa, rank() OVER (PARTITION BY dyad, trial ORDER BY rb) AS qb FROM rest),
        ranks AS (SELECT dyad, trial, {r_sql("qa", "qb")} AS rho FROM ranked GROUP BY ALL),
        best AS (SELECT * FROM cc WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dyad, trial ORDER BY round(abs(c), 12) DESC, lag) = 1),
        shifted AS (SELECT dyad, trial, a, b, lead(a) OVER w AS a1, lead(b) OVER w AS b1 FROM dyads WINDOW w AS (PARTITION BY dyad, trial ORDER BY k)),
        one AS (SELECT dyad, trial, {r_sql("a", "b1")} AS r_ab, {r_sql("b", "a1")} AS r_ba FROM shifted WHERE a1 IS NOT NULL GROUP BY ALL),
        spans AS (SELECT dyad, trial, min(t) AS t0, max(t) AS t1 FROM dyads GROUP BY ALL),
        starts AS (SELECT dyad, trial, i, t0 + i * 43200.0::DOUBLE AS s FROM (SELECT *, unnest(generate_series(0, floor((greatest(t1 - t0 - 86400, 0) + 1e-12) / 43200)::BIGINT)) AS i FROM spans)),
        rs AS (SELECT x.dyad, x.trial, i, {r_sql("a", "b")} AS r FROM starts x JOIN dyads d ON d.dyad = x.dyad AND d.trial = x.trial AND d.t BETWEEN s AND s + 86400 GROUP BY ALL HAVING count(*) >= 20),
        windows AS (SELECT dyad, trial, count(*) AS n_windows, avg(r) AS window_r_mean, stddev_samp(r) AS window_r_sd, min(r) AS window_r_min, max(r) AS window_r_max FROM rs GROUP BY ALL),
        met AS (SELECT *, c AS peak_r, r_ab - r_ba AS asymmetry, CASE WHEN pearson_r IS NOT NULL THEN rho END AS spearman_r FROM base LEFT JOIN linear USING (dyad, trial) LEFT JOIN ranks USING (dyad, trial) LEFT JOIN best USING (dyad, trial)
          LEFT JOIN one USING (dyad, trial) LEFT JOIN windows USING (dyad, trial))
        SELECT dyad, trial, CASE WHEN n < 20 THEN 'failed' ELSE 'success' END AS status, CASE WHEN n < 20 THEN 'Too few valid paired samples: ' || n END AS error, n,
          CASE WHEN n >= 20 THEN lag END AS lag, CASE WHEN n >= 20 THEN CASE WHEN round(asymmetry, 12) > 0 THEN 'A' WHEN round(asymmetry, 12) < 0 THEN 'B' WHEN round(asymmetry, 12) = 0 THEN 'symmetric' ELSE 'unavailable' END END AS lag_one_leader,
          CASE WHEN n >= 20 THEN coalesce(n_windows, 0) END AS n_windows, {", ".join(f"CASE WHEN n >= 20 THEN round({c}, 6) + 0.0::DOUBLE END AS {c}" for c in _PLAIN)} FROM met""",
}
