"""Queries on single series and on windows of pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import mean_ci, rounded
from ..operators import halves, series, signal, summary, synchrony, transfer
from .standin import DYADS, GRID, SAMPLES, dyads, r_sql, readings, samples


def _r(*names: str, digits: int = 6):
    return [rounded(F.col(n), digits).alias(n) for n in names]


TAUS = range(1, 14)
#: Shuffles of each series.
HALVES = 1000


def hourly_grid(spark, sf):
    grid = series.to_grid(readings(spark, sf), ["sensor"], 3600.0, tie="event_id")
    return grid.select("sensor", F.col("k").cast("long").alias("k"), *_r("x"))


def windowed_sync(spark, sf):
    """Sliding-window correlation of each dyad and its spread: the flagship query."""
    w = synchrony.windowed(dyads(spark, sf), ["dyad"], 48 * 3600.0, 24 * 3600.0)
    out = w.groupBy("dyad").agg(F.count("r").alias("n_windows"), F.sum("n").alias("n_samples"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"), F.min("r").alias("min_r"), F.max("r").alias("max_r"))
    return out.select("dyad", "n_windows", "n_samples", *_r("mean_r", "sd_r", "min_r", "max_r"))


def window_correlations(spark, sf):
    w = synchrony.windowed(dyads(spark, sf), ["dyad"], 48 * 3600.0, 24 * 3600.0)
    return w.select("dyad", F.col("window_index").cast("long").alias("window_index"), "start", "n", *_r("r"))


def gap_groups(spark, sf):
    s = readings(spark, sf)
    g = series.gap_groups(s, ["sensor"], "t", 12 * 3600.0, "event_id")
    g = g.groupBy("sensor", "group").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ";").alias("ids"))
    return g.select("sensor", F.col("group").cast("long").alias("group_no"), "n", *_r("first", "last", digits=3), "ids", F.when(F.col("n") == 9, "ok").otherwise("expected_9").alias("note"))


def rr_intervals(spark, sf):
    rr = series.intervals(readings(spark, sf), ["sensor"])
    return rr.select("sensor", "interval_number", *_r("middle", "rr_ms", digits=3), rounded(F.col("hr_bpm"), 9).alias("hr_bpm"))


def scores(spark, sf):
    s = samples(spark, sf)
    s = s.select("sensor", "n", series.zscore("x", ["sensor"], 1).alias("z_sample"), series.zscore("x", ["sensor"], 0).alias("z_population"))
    return s.select("sensor", "n", *_r("z_sample", "z_population"))


def detrended(spark, sf):
    return series.detrended(samples(spark, sf), ["sensor"], "x", "n", "rest").select("sensor", "n", *_r("rest", digits=7))


def gap_filled(spark, sf):
    s = samples(spark, sf).withColumn("x", F.when(~F.col("event_type").isin("error", "signup"), F.col("x")))
    return series.filled(s, ["sensor"], "x", "n", "filled").select("sensor", "n", *_r("filled"))


def contiguous_windows(spark, sf):
    d = dyads(spark, sf).where("abs(a - b) < 60")
    w = series.count_windows(series.runs(d, ["dyad"], 3600.0, 0.02), ["dyad"], 12, 3)
    out = w.groupBy("dyad", "run", "window").agg(F.min("k").alias("first_k"), F.count("*").alias("n"), F.avg("a").alias("mean_a"))
    return out.select("dyad", F.col("run").cast("long").alias("run"), F.col("window").cast("long").alias("win"), F.col("first_k").cast("long").alias("first_k"), "n", *_r("mean_a"))


def timeline(spark, sf):
    s = samples(spark, sf).withColumn("trial", F.floor((F.col("n") - 1) / 30))
    return series.timeline(s, ["sensor"], ["trial"]).select("sensor", "n", *_r("line_t", digits=3))


def segment_summary(spark, sf):
    s = samples(spark, sf).withColumn("trial", F.floor((F.col("n") - 1) / 30))
    out = summary.segment_summary(s, ["sensor", "trial"], F.col("x"), "t", target=10 * 86400.0)
    return out.select("sensor", F.col("trial").cast("long").alias("trial"), "n", "n_extreme", *_r("mean_hr", "sd_hr", "min_hr", "max_hr", "range_hr", "median_hr", "plausible_percent", "extreme_percent", "coverage_percent"), *_r("duration", digits=3))


def odd_even_reliability(spark, sf):
    rr = series.intervals(readings(spark, sf), ["sensor"])
    return summary.odd_even(rr, ["sensor"], "rr_ms", "interval_number").select("sensor", "n_pairs", *_r("r"), "status", "label")


def split_halves(spark, sf):
    out = summary.split_halves(samples(spark, sf), ["sensor", "event_type"], "x", F.col("n"))
    return out.select("sensor", "event_type", "n_samples", "n_odd", "n_even", *_r("odd_half_mean", "even_half_mean", digits=8))


def random_halves(spark, sf):
    s = samples(spark, sf).withColumn("place", F.col("n") - 1)
    out = halves.random_halves(s, ["sensor"], F.col("sensor"), "x", "place", HALVES, 448)
    return out.select("sensor", "iteration", "n_samples", "n_odd", "n_even", *_r("odd_half_mean", "even_half_mean", digits=8))


def poincare(spark, sf):
    out = synchrony.poincare(samples(spark, sf), ["sensor"], "x", "n")
    return out.select("sensor", "n", *_r("mean_nn", "sdnn", "rmssd", "pnn50", "sd1", "sd2", "sd2_total", "r", "sd_ratio"))


def bland_altman(spark, sf):
    return synchrony.bland_altman(dyads(spark, sf), ["dyad"]).select("dyad", "n", *_r("bias", "sd", "lower", "upper"))


def session_overlap(spark, sf):
    out = synchrony.session_overlap(dyads(spark, sf), ["dyad"], 48 * 3600.0, 24 * 3600.0)
    return out.select("dyad", "n", "first", "last", F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), *_r("r", "window_mean", "window_sd", "window_min", "window_max"))


def prepared_pairs(spark, sf):
    """Pairs of trials without their lines, standardised, with the status of the preparation."""
    out = series.prepared_pairs(dyads(spark, sf), ["dyad", "trial"], "k")
    return out.select("dyad", F.col("trial").cast("long").alias("trial"), F.col("k").cast("long").alias("k"), "status", *_r("za", "zb"))


def spearman(spark, sf):
    return synchrony.spearman(dyads(spark, sf), ["dyad", "trial"]).select("dyad", F.col("trial").cast("long").alias("trial"), "n", *_r("rho"))


def lag_one(spark, sf):
    out = synchrony.lag_one(dyads(spark, sf), ["dyad"], "k")
    return out.select("dyad", *_r("r_ab", "r_ba", "asymmetry"), "leader")


def cross_correlation(spark, sf):
    cc = synchrony.cross_correlation(dyads(spark, sf), ["dyad", "trial"], "k", 10)
    return synchrony.peak_lag(cc, ["dyad", "trial"]).select("dyad", F.col("trial").cast("long").alias("trial"), F.col("lag").cast("long").alias("lag"), *_r("peak"), "leader_positive_lag_a", "leader_positive_lag_b")


def prediction_delay(spark, sf):
    cc = synchrony.cross_correlation(dyads(spark, sf), ["dyad", "trial"], "k", 10)
    best = synchrony.peak_lag(cc, ["dyad", "trial"], signed=True)
    return best.select("dyad", F.col("trial").cast("long").alias("trial"), F.greatest(F.col("lag"), F.lit(1)).cast("long").alias("delta"))


def ellipse(spark, sf):
    return synchrony.ellipse(dyads(spark, sf), ["dyad"]).select("dyad", "n", *_r("major", "minor", "angle", "limit_low", "limit_high"))


def leader_votes(spark, sf):
    """Leaders of trials by lag, lag-one asymmetry and mean phase."""
    d, keys = dyads(spark, sf), ["dyad", "trial"]
    lag = synchrony.peak_lag(synchrony.cross_correlation(d, keys, "k", 10), keys)
    phase = signal.phases_by_key(d, keys, "k")
    both = lag.join(synchrony.lag_one(d, keys, "k"), keys).join(phase.select(*keys, "mean_phase"), keys)
    leader, sure = synchrony.leader_vote(F.col("lag") * 3600.0, F.round("asymmetry", 9), F.round("mean_phase", 9))
    return both.select("dyad", F.col("trial").cast("long").alias("trial"), leader.alias("leader"), rounded(sure).alias("confidence"))


def ordinal_symbols(spark, sf):
    s = transfer.symbols(dyads(spark, sf), ["dyad"], "k", 3, 2)
    return s.groupBy("dyad", F.col("sa").cast("long").alias("sa")).agg(F.count("*").alias("n"))


def transfer_entropy(spark, sf):
    """Observed symbolic transfer entropy of trials for the lags 1 to 13 of the embedding."""
    te = transfer.transfer_of_trials(dyads(spark, sf), ["dyad", "trial"], "k", list(TAUS))
    return te.select("dyad", F.col("trial").cast("long").alias("trial"), "tau", *_r("ste_ab", "ste_ba", "h_ab", "h_ba", "asymmetry"))


def optimal_tau(spark, sf):
    te = transfer.transfer_of_trials(dyads(spark, sf), ["dyad", "trial"], "k", list(TAUS)).withColumn("flow", F.col("ste_ab") + F.col("ste_ba"))
    return transfer.optimal_tau(te, ["dyad"], "tau", "flow").select("dyad", "tau", *_r("mean_flow"))


def window_means(spark, sf):
    """Mean and confidence interval of the window correlations by window."""
    w = synchrony.windowed(dyads(spark, sf), ["dyad"], 48 * 3600.0, 24 * 3600.0)
    out = w.groupBy(F.col("window_index").cast("long").alias("window_index")).agg(F.count("r").alias("n"), *[c.alias(k) for k, c in mean_ci(F.col("r")).items()])
    return out.select("window_index", "n", *_r("mean", "half_width"))


NAMES = (
    hourly_grid, windowed_sync, window_correlations, gap_groups, rr_intervals, scores, detrended, gap_filled, contiguous_windows,
    timeline, segment_summary, odd_even_reliability, split_halves, random_halves, poincare, bland_altman, session_overlap, prepared_pairs, spearman, lag_one,
    cross_correlation, prediction_delay, ellipse, leader_votes, ordinal_symbols, transfer_entropy, optimal_tau, window_means,
)
QUERIES = {f.__name__: f for f in NAMES}

_WINDOWS = f"""{DYADS}, spans AS (SELECT dyad, min(t) AS t0, max(t) AS t1 FROM dyads GROUP BY dyad), starts AS (
  SELECT dyad, i AS window_index, t0 + i * 86400.0::DOUBLE AS start FROM (
    SELECT *, unnest(generate_series(0, floor((greatest(t1 - t0 - 172800, 0) + 1e-12) / 86400)::BIGINT)) AS i FROM spans)), windows AS (
  SELECT s.dyad, window_index, start, count(*) AS n, {r_sql("a", "b")} AS r
  FROM starts s JOIN dyads d ON d.dyad = s.dyad AND d.t BETWEEN start AND start + 172800 GROUP BY ALL HAVING count(*) >= 20)"""

_RR = f"""{SAMPLES}, rr AS (
  SELECT sensor, row_number() OVER (PARTITION BY sensor ORDER BY t0) AS interval_number, (t0 + t1) / 2 AS middle, (t1 - t0) * 1000 AS rr_ms
  FROM (SELECT sensor, t AS t0, lead(t) OVER (PARTITION BY sensor ORDER BY t) AS t1 FROM samples) WHERE t1 > t0)"""

LAGS = f"""{DYADS}, placed AS (
  SELECT dyad, KEY, row_number() OVER w AS pos, a - avg(a) OVER v AS x, b - avg(b) OVER v AS y FROM dyads
  WINDOW w AS (PARTITION BY dyad, KEY ORDER BY k), v AS (PARTITION BY dyad, KEY)), cc AS (
  SELECT p.dyad, p.KEY, l.lag, sum(p.x * q.y) / nullif(any_value(m.norm), 0) AS c FROM placed p
  JOIN range(-10, 11) AS l(lag) ON true JOIN placed q ON q.dyad = p.dyad AND q.KEY = p.KEY AND q.pos = p.pos - l.lag
  JOIN (SELECT dyad, KEY, sqrt(sum(x * x) * sum(y * y)) AS norm FROM placed GROUP BY ALL) m ON m.dyad = p.dyad AND m.KEY = p.KEY
  GROUP BY p.dyad, p.KEY, l.lag)"""
_LAG_ONE = f"""shifted AS (SELECT dyad, a, b, lead(a) OVER w AS a1, lead(b) OVER w AS b1 FROM dyads WINDOW w AS (PARTITION BY dyad ORDER BY k)), one AS (
  SELECT dyad, {r_sql("a", "b1")} AS r_ab, {r_sql("b", "a1")} AS r_ba FROM shifted WHERE a1 IS NOT NULL GROUP BY dyad)"""


def _symbols(keys: str, tau: int) -> str:
    """symbols(keys, pos, sa, sb) of dyads."""

    def rank(x: str) -> str:
        e = [x, f"lead({x}, {tau}) OVER w", f"lead({x}, {2 * tau}) OVER w"]
        digit = []
        for j in range(3):
            digit.append("1" + "".join(f" + ({e[k]} {'<=' if k < j else '<'} {e[j]})::INT" for k in range(3) if k != j))
        return f"100 * ({digit[0]}) + 10 * ({digit[1]}) + ({digit[2]})"

    return f"(SELECT {keys}, row_number() OVER w AS pos, {rank('a')} AS sa, {rank('b')} AS sb FROM dyads WINDOW w AS (PARTITION BY {keys} ORDER BY k) QUALIFY lead(k, {2 * tau}) OVER w IS NOT NULL)"


_TE = f"""{DYADS}, syms AS MATERIALIZED ({" UNION ALL ".join(f"SELECT *, {t}::BIGINT AS tau FROM {_symbols('dyad, trial', t)}" for t in TAUS)}),
  ahead AS (SELECT dyad, trial, tau, sa, sb, lead(sa) OVER w AS fa, lead(sb) OVER w AS fb FROM syms WINDOW w AS (PARTITION BY dyad, trial, tau ORDER BY pos)),
  counts AS (SELECT dyad, trial, tau, way, f, p, s, count(*)::DOUBLE AS c FROM (
    SELECT dyad, trial, tau, 'ab' AS way, fb AS f, sb AS p, sa AS s FROM ahead WHERE fa IS NOT NULL
    UNION ALL SELECT dyad, trial, tau, 'ba', fa, sa, sb FROM ahead WHERE fa IS NOT NULL) GROUP BY ALL),
  shares AS (SELECT dyad, trial, tau, way, c / sum(c) OVER w AS p1, sum(c) OVER (PARTITION BY dyad, trial, tau, way, p, s) / sum(c) OVER w AS p2,
    sum(c) OVER (PARTITION BY dyad, trial, tau, way, f, p) / sum(c) OVER w AS p3, sum(c) OVER (PARTITION BY dyad, trial, tau, way, p) / sum(c) OVER w AS p4
    FROM counts WINDOW w AS (PARTITION BY dyad, trial, tau, way)),
  te AS (SELECT dyad, trial, tau, sum(p1 * (log2(p1 * p4) - log2(p2 * p3))) FILTER (way = 'ab') AS ab, sum(p1 * (log2(p1 * p4) - log2(p2 * p3))) FILTER (way = 'ba') AS ba,
    -sum(p3 * (log2(p3) - log2(p4))) FILTER (way = 'ab') AS hab, -sum(p3 * (log2(p3) - log2(p4))) FILTER (way = 'ba') AS hba FROM shares GROUP BY ALL)"""

#: The phase differences d of the members' analytic signals in trials: a circular convolution with the discrete Hilbert kernel.
PHASES = f"""{DYADS}, p AS (SELECT dyad, trial, row_number() OVER w - 1 AS i, count(*) OVER v AS n, a, b FROM dyads WINDOW w AS (PARTITION BY dyad, trial ORDER BY k), v AS (PARTITION BY dyad, trial)),
        l AS (SELECT dyad, trial, regr_slope(a, i) AS sa, regr_intercept(a, i) AS ia, regr_slope(b, i) AS sb, regr_intercept(b, i) AS ib FROM p GROUP BY ALL),
        q AS (SELECT dyad, trial, i, n, a - ia - sa * i AS a, b - ib - sb * i AS b FROM p JOIN l USING (dyad, trial) WHERE n >= 10
          WINDOW v AS (PARTITION BY dyad, trial) QUALIFY stddev_pop(p.a - ia - sa * i) OVER v > 1e-9 * max(abs(p.a)) OVER v AND stddev_pop(p.b - ib - sb * i) OVER v > 1e-9 * max(abs(p.b)) OVER v),
        h AS (SELECT x.dyad, x.trial, x.i, x.n, any_value(x.a) AS a, any_value(x.b) AS b, sum(y.a * g) AS ha, sum(y.b * g) AS hb FROM (
            SELECT x.*, y.a AS ya, y.b AS yb, y.i AS yi, (x.i - y.i + x.n) % x.n AS m FROM q x JOIN q y ON y.dyad = x.dyad AND y.trial = x.trial) x
          JOIN q y ON y.dyad = x.dyad AND y.trial = x.trial AND y.i = x.yi, LATERAL (SELECT CASE WHEN m = 0 THEN 0 WHEN x.n % 2 = 0 THEN CASE WHEN m % 2 = 1 THEN 2.0 / x.n * cot(pi() * m / x.n) ELSE 0 END
            ELSE (cot(pi() * m / x.n) - cos(pi() * m) / sin(pi() * m / x.n)) / x.n END AS g) GROUP BY x.dyad, x.trial, x.i, x.n),
        d AS (SELECT *, atan2(ha, a) - atan2(hb, b) AS d, sqrt(a * a + ha * ha) AS ea, sqrt(b * b + hb * hb) AS eb FROM h)"""

ORACLES = {
    "hourly_grid": f"WITH {GRID} SELECT sensor, k, round(x, 6) AS x FROM grid",
    "windowed_sync": f"""WITH {_WINDOWS} SELECT dyad, count(r) AS n_windows, sum(n)::BIGINT AS n_samples, round(avg(r), 6) AS mean_r,
        round(stddev_samp(r), 6) AS sd_r, round(min(r), 6) AS min_r, round(max(r), 6) AS max_r FROM windows GROUP BY dyad""",
    "window_correlations": f"WITH {_WINDOWS} SELECT dyad, window_index, start, n, round(r, 6) AS r FROM windows",
    "gap_groups": f"""WITH {SAMPLES}, marked AS (
        SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sensor ORDER BY t, event_id) <= 43200 THEN 0 ELSE 1 END AS opens FROM samples), g AS (
        SELECT *, sum(opens) OVER (PARTITION BY sensor ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM marked)
        SELECT sensor, group_no, count(*) AS n, round(min(t), 3) AS first, round(max(t), 3) AS last, string_agg(event_id::VARCHAR, ';' ORDER BY event_id) AS ids,
               CASE WHEN count(*) = 9 THEN 'ok' ELSE 'expected_9' END AS note FROM g GROUP BY sensor, group_no""",
    "rr_intervals": f"WITH {_RR} SELECT sensor, interval_number, round(middle, 3) AS middle, round(rr_ms, 3) AS rr_ms, round(60000 / rr_ms, 9) AS hr_bpm FROM rr",
    "scores": f"""WITH {SAMPLES} SELECT sensor, n, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) + 0.0::DOUBLE AS z_sample,
        round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) + 0.0::DOUBLE AS z_population FROM samples WINDOW w AS (PARTITION BY sensor)""",
    "detrended": f"""WITH {SAMPLES}, line AS (SELECT sensor, regr_slope(x, n) AS b, regr_intercept(x, n) AS a FROM samples GROUP BY sensor)
        SELECT sensor, n, round(x - a - b * n, 7) + 0.0::DOUBLE AS rest FROM samples JOIN line USING (sensor)""",
    "gap_filled": f"""WITH {SAMPLES}, known AS (SELECT sensor, n, x FROM samples WHERE event_type NOT IN ('error', 'signup'))
        SELECT s.sensor, s.n, round(CASE WHEN p.n IS NULL THEN q.x WHEN q.n IS NULL OR p.n = q.n THEN p.x
                ELSE p.x + (s.n - p.n) * (q.x - p.x) / (q.n - p.n) END, 6) AS filled
        FROM samples s ASOF LEFT JOIN known p ON p.sensor = s.sensor AND p.n <= s.n ASOF LEFT JOIN known q ON q.sensor = s.sensor AND q.n >= s.n""",
    "contiguous_windows": f"""WITH {DYADS}, near AS (SELECT *, k - row_number() OVER (PARTITION BY dyad ORDER BY k) AS island FROM dyads WHERE abs(a - b) < 60),
        r AS (SELECT *, dense_rank() OVER (PARTITION BY dyad ORDER BY island) AS run, row_number() OVER (PARTITION BY dyad, island ORDER BY k) - 1 AS pos,
                     count(*) OVER (PARTITION BY dyad, island) AS size FROM near),
        w AS (SELECT dyad, run, i AS win FROM (SELECT DISTINCT dyad, run, size FROM r) s, range(0, 1000) AS g(i) WHERE 3 * i + 12 <= size)
        SELECT r.dyad, r.run, w.win, min(k) AS first_k, count(*) AS n, round(avg(a), 6) AS mean_a
        FROM w JOIN r ON r.dyad = w.dyad AND r.run = w.run AND r.pos BETWEEN 3 * win AND 3 * win + 11 GROUP BY ALL""",
    "timeline": f"""WITH {SAMPLES}, b AS (SELECT *, (n - 1) // 30 AS trial FROM samples), s AS (SELECT sensor, trial, min(t) AS t0, max(t) - min(t) + 5 AS span FROM b GROUP BY ALL),
        o AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY sensor ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
        SELECT sensor, n, round(t - t0 + off, 3) AS line_t FROM b JOIN o USING (sensor, trial)""",
    "segment_summary": f"""WITH {SAMPLES} SELECT sensor, (n - 1) // 30 AS trial, count(x) AS n, count(*) FILTER (x < 40 OR x > 200) AS n_extreme, round(avg(x), 6) AS mean_hr,
        round(stddev_samp(x), 6) AS sd_hr, min(x) AS min_hr, max(x) AS max_hr, round(max(x) - min(x), 6) AS range_hr, round(median(x), 6) AS median_hr,
        round(100 * avg((60000 / x BETWEEN 300 AND 2000)::INT), 6) AS plausible_percent, round(100 * avg((x < 40 OR x > 200)::INT), 6) AS extreme_percent,
        round(least(100, (max(t) - min(t)) / 864000 * 100), 6) AS coverage_percent, round(max(t) - min(t), 3) AS duration FROM samples GROUP BY ALL""",
    "odd_even_reliability": f"""WITH {_RR}, p AS (SELECT sensor, (interval_number - 1) // 2 AS pair, max(rr_ms) FILTER (interval_number % 2 = 1) AS odd, max(rr_ms) FILTER (interval_number % 2 = 0) AS even FROM rr GROUP BY ALL),
        c AS (SELECT sensor, count(*) AS n_pairs, {r_sql("odd", "even", 10)} AS r FROM p WHERE even IS NOT NULL GROUP BY sensor)
        SELECT sensor, n_pairs, round(r, 6) AS r, CASE WHEN n_pairs < 10 THEN 'too_few_pairs' WHEN r IS NULL THEN 'undefined_correlation' ELSE 'success' END AS status,
               CASE WHEN r IS NULL THEN 'unavailable' WHEN r >= 0.75 THEN 'reliable' WHEN r >= 0.5 THEN 'caution' ELSE 'low' END AS label FROM c""",
    "split_halves": f"""WITH {SAMPLES}, o AS (SELECT sensor, event_type, x, row_number() OVER (PARTITION BY sensor, event_type ORDER BY n) % 2 = 1 AS odd FROM samples)
        SELECT sensor, event_type, count(*) AS n_samples, count(*) FILTER (odd) AS n_odd, count(*) FILTER (NOT odd) AS n_even, round(avg(x) FILTER (odd), 8) AS odd_half_mean,
               round(avg(x) FILTER (NOT odd), 8) AS even_half_mean FROM o GROUP BY ALL HAVING count(*) FILTER (odd) >= 2 AND count(*) FILTER (NOT odd) >= 2""",
    "random_halves": f"""WITH {SAMPLES}, u AS (SELECT sensor, x, n - 1 AS p, count(*) OVER (PARTITION BY sensor) AS cnt FROM samples), {halves.sql("u", "sensor", HALVES, 448)}
        SELECT sensor, iteration, count(*) AS n_samples, count(*) FILTER (odd) AS n_odd, count(*) FILTER (NOT odd) AS n_even, round(avg(x) FILTER (odd), 8) AS odd_half_mean,
               round(avg(x) FILTER (NOT odd), 8) AS even_half_mean FROM halves GROUP BY sensor, iteration HAVING count(*) FILTER (odd) >= 2 AND count(*) FILTER (NOT odd) >= 2""",
    "poincare": f"""WITH {SAMPLES}, p AS (SELECT sensor, x, lead(x) OVER (PARTITION BY sensor ORDER BY n) AS y FROM samples)
        SELECT sensor, count(*) AS n, round(avg(x), 6) AS mean_nn, round(stddev_samp(x), 6) AS sdnn, round(sqrt(avg((y - x) * (y - x))), 6) AS rmssd, round(100 * avg((abs(y - x) > 50)::INT), 6) AS pnn50,
          round(sqrt(0.5) * stddev_samp(y - x), 6) AS sd1, round(sqrt(0.5) * stddev_samp(y + x), 6) AS sd2, round(sqrt(greatest(2 * var_samp(x) - 0.5 * var_samp(y - x), 0)), 6) AS sd2_total,
          round(covar_samp(x, y) / (stddev_samp(CASE WHEN y IS NOT NULL THEN x END) * stddev_samp(y)), 6) AS r, round(stddev_samp(y - x) / stddev_samp(y + x), 6) AS sd_ratio FROM p GROUP BY sensor""",
    "bland_altman": f"""WITH {DYADS} SELECT dyad, count(*) AS n, round(avg(a - b), 6) AS bias, round(stddev_samp(a - b), 6) AS sd, round(avg(a - b) - 1.96 * stddev_samp(a - b), 6) AS lower,
        round(avg(a - b) + 1.96 * stddev_samp(a - b), 6) AS upper FROM dyads GROUP BY dyad HAVING count(*) >= 3""",
    "session_overlap": f"""WITH {DYADS}, whole AS (SELECT dyad, count(*) AS n, min(t) AS first, max(t) AS last, {r_sql("a", "b")} AS r FROM dyads GROUP BY dyad),
        starts AS (SELECT dyad, i, first + i * 86400.0::DOUBLE AS s FROM (SELECT *, unnest(generate_series(0, greatest(ceil(greatest(last - first - 172800, 0) / 86400)::BIGINT - 1, 0))) AS i FROM whole)),
        w AS (SELECT x.dyad, i, {r_sql("a", "b")} AS r FROM starts x JOIN dyads d ON d.dyad = x.dyad AND d.t BETWEEN s AND s + 172800 GROUP BY ALL HAVING count(*) >= 20),
        m AS (SELECT dyad, count(*) AS n_windows, avg(r) AS a, stddev_samp(r) AS s, min(r) AS lo, max(r) AS hi FROM w GROUP BY dyad)
        SELECT dyad, n, first, last, coalesce(n_windows, 0) AS n_windows, round(r, 6) AS r, round(a, 6) AS window_mean, round(s, 6) AS window_sd, round(lo, 6) AS window_min, round(hi, 6) AS window_max
        FROM whole LEFT JOIN m USING (dyad)""",
    "prepared_pairs": f"""WITH {DYADS}, line AS (SELECT dyad, trial, count(*) AS n, regr_slope(a, k % 48) AS sa, regr_intercept(a, k % 48) AS ia, regr_slope(b, k % 48) AS sb, regr_intercept(b, k % 48) AS ib FROM dyads GROUP BY ALL),
        rest AS (SELECT dyad, trial, k, n, a, b, a - ia - sa * (k % 48) AS ra, b - ib - sb * (k % 48) AS rb FROM dyads JOIN line USING (dyad, trial)),
        s AS (SELECT *, CASE WHEN n < 20 THEN 'too_few_samples' WHEN stddev_pop(ra) OVER w <= 1e-9 * max(abs(a)) OVER w OR stddev_pop(rb) OVER w <= 1e-9 * max(abs(b)) OVER w THEN 'zero_sd' ELSE 'success' END AS status
          FROM rest WINDOW w AS (PARTITION BY dyad, trial))
        SELECT dyad, trial, k, status, CASE WHEN status = 'success' THEN round((ra - avg(ra) OVER w) / nullif(stddev_pop(ra) OVER w, 0), 6) + 0.0::DOUBLE END AS za,
               CASE WHEN status = 'success' THEN round((rb - avg(rb) OVER w) / nullif(stddev_pop(rb) OVER w, 0), 6) + 0.0::DOUBLE END AS zb FROM s WINDOW w AS (PARTITION BY dyad, trial)""",
    "spearman": f"""WITH {DYADS}, r AS (SELECT dyad, trial, rank() OVER (PARTITION BY dyad, trial ORDER BY a) + (count(*) OVER (PARTITION BY dyad, trial, a) - 1) / 2 AS ra,
        rank() OVER (PARTITION BY dyad, trial ORDER BY b) + (count(*) OVER (PARTITION BY dyad, trial, b) - 1) / 2 AS rb FROM dyads)
        SELECT dyad, trial, count(*) AS n, round({r_sql("ra", "rb")}, 6) AS rho FROM r GROUP BY ALL""",
    "lag_one": f"""WITH {DYADS}, {_LAG_ONE} SELECT dyad, round(r_ab, 6) AS r_ab, round(r_ba, 6) AS r_ba, round(r_ab - r_ba, 6) AS asymmetry,
        CASE WHEN round(r_ab - r_ba, 12) > 0 THEN 'A' WHEN round(r_ab - r_ba, 12) < 0 THEN 'B' WHEN round(r_ab - r_ba, 12) = 0 THEN 'symmetric' ELSE 'unavailable' END AS leader FROM one""",
    "cross_correlation": f"""WITH {LAGS.replace("KEY", "trial")}, best AS (SELECT * FROM cc WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dyad, trial ORDER BY round(abs(c), 12) DESC, lag) = 1)
        SELECT dyad, trial, lag, round(c, 6) AS peak, CASE WHEN lag = 0 THEN 'zero_lag' WHEN lag > 0 THEN 'A' ELSE 'B' END AS leader_positive_lag_a,
               CASE WHEN lag = 0 THEN 'zero_lag' WHEN lag > 0 THEN 'B' ELSE 'A' END AS leader_positive_lag_b FROM best""",
    "prediction_delay": f"""WITH {LAGS.replace("KEY", "trial")} SELECT dyad, trial, greatest(1, lag) AS delta FROM cc WHERE c IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY dyad, trial ORDER BY round(c, 12) DESC, lag) = 1""",
    "ellipse": f"""WITH {DYADS}, m AS (SELECT dyad, count(*) AS n, covar_samp(a, b) AS c, (var_samp(a) + var_samp(b)) / 2 AS half, (var_samp(a) - var_samp(b)) / 2 AS dif,
          quantile_cont(a, 0.005) AS lo, quantile_cont(a, 0.995) AS hi FROM dyads GROUP BY dyad)
        SELECT dyad, n, round(2 * sqrt(half + sqrt(dif * dif + c * c)), 6) AS major, round(2 * sqrt(greatest(half - sqrt(dif * dif + c * c), 0)), 6) AS minor,
          round(degrees(0.5 * atan2(2 * c, 2 * dif)), 6) AS angle, round(lo - 0.2 * (hi - lo), 6) AS limit_low, round(hi + 0.2 * (hi - lo), 6) AS limit_high FROM m""",
    "leader_votes": f"""WITH {PHASES}, m AS (SELECT dyad, trial, round(atan2(avg(sin(d)), avg(cos(d))), 9) AS phase FROM d GROUP BY ALL),
        {LAGS.replace("KEY", "trial").replace(DYADS + ", ", "")},
        shifted AS (SELECT dyad, trial, a, b, lead(a) OVER w AS a1, lead(b) OVER w AS b1 FROM dyads WINDOW w AS (PARTITION BY dyad, trial ORDER BY k)),
        one AS (SELECT dyad, trial, round({r_sql("a", "b1")} - {r_sql("b", "a1")}, 9) AS asym FROM shifted WHERE a1 IS NOT NULL GROUP BY ALL),
        best AS (SELECT * FROM cc WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dyad, trial ORDER BY round(abs(c), 12) DESC, lag) = 1),
        v AS (SELECT dyad, trial, (lag > 0)::INT + coalesce((asym > 0.05)::INT, 0) + (phase > 0)::INT AS va, (lag < 0)::INT + coalesce((asym < -0.05)::INT, 0) + (phase <= 0)::INT AS vb
          FROM best JOIN one USING (dyad, trial) JOIN m USING (dyad, trial))
        SELECT dyad, trial, CASE WHEN va > vb THEN 'A' WHEN vb > va THEN 'B' ELSE 'SYMMETRIC' END AS leader, round(greatest(va, vb) / (va + vb), 6)::DOUBLE AS confidence FROM v""",
    "ordinal_symbols": f"WITH {DYADS} SELECT dyad, sa::BIGINT AS sa, count(*) AS n FROM {_symbols('dyad', 2)} GROUP BY ALL",
    "transfer_entropy": f"""WITH {_TE} SELECT dyad, trial, tau, round(ab, 6) + 0.0::DOUBLE AS ste_ab, round(ba, 6) + 0.0::DOUBLE AS ste_ba, round(hab, 6) + 0.0::DOUBLE AS h_ab,
        round(hba, 6) + 0.0::DOUBLE AS h_ba, round(ab - ba, 6) + 0.0::DOUBLE AS asymmetry FROM te""",
    "optimal_tau": f"""WITH {_TE}, m AS (SELECT dyad, tau, avg(ab + ba) AS m FROM te GROUP BY ALL)
        SELECT dyad, tau, round(m, 6) AS mean_flow FROM m QUALIFY row_number() OVER (PARTITION BY dyad ORDER BY round(m, 12) DESC, tau) = 1""",
    "window_means": f"""WITH {_WINDOWS} SELECT window_index, count(r) AS n, round(avg(r), 6) + 0.0::DOUBLE AS mean, round(1.96 * stddev_samp(r) / sqrt(count(r)), 6) AS half_width FROM windows GROUP BY window_index""",
}
