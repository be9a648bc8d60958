"""Queries on joins, roll-ups, quality flags and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.stats import pearson, rounded
from ..operators import matching, pairing, series, summary, trial
from ..sources import files
from ..operators.quantiles import quantiles
from .standin import DYADS, SAMPLES, dyads, r_sql, readings, samples, seconds, table


def _r(*names: str, digits: int = 6):
    return [rounded(F.col(n), digits).alias(n) for n in names]


def _trials(spark, sf):
    return samples(spark, sf).withColumn("trial", F.floor((F.col("n") - 1) / 30).cast("long"))


_TRIALS = f"{SAMPLES}, trials AS (SELECT *, (n - 1) // 30 AS trial FROM samples)"


# ---- joins


def enrichment(spark, sf):
    """Left equi-join on two keys: line items with the order's own first line."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    first = li.where("l_linenumber = 1").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("first_quantity"))
    out = li.join(first, ["l_orderkey", "l_suppkey"], "left").join(o, li["l_orderkey"] == o["o_orderkey"], "left")
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("first_quantity").alias("n_found"), rounded(F.sum("first_quantity"), 2).alias("quantity"))


def flag_lookup(spark, sf):
    """Dictionary lookup, last row wins, with a word for what is absent."""
    s = samples(spark, sf)
    trials = s.select("sensor", "n", "event_id")
    flags = s.where("event_type in ('error', 'signup')").select((F.col("sensor") + 1).alias("sensor"), F.col("event_type").alias("flag"), F.col("t").alias("__t"))
    out = pairing.lookup(trials, flags, ["sensor"], ["flag"], "__t")
    return out.groupBy("sensor", "flag").agg(F.count("*").alias("n"))


def two_stage_lookup(spark, sf):
    """By file name, else by key: suppliers named in one list, then by nation."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    named = s.where("s_acctbal >= 0").select(F.regexp_replace("s_name", "Supplier", "Customer").alias("c_name"), F.col("s_acctbal").alias("by_name"))
    keyed = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("by_key"))
    out = c.join(named, "c_name", "left").join(F.broadcast(keyed), "c_nationkey", "left")
    source = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_key").isNotNull(), "key").otherwise("none")
    return out.select("c_custkey", F.coalesce("by_name", "by_key").alias("value"), source.alias("source"))


def nearest_session(spark, sf):
    """Each purchase with the nearest error of its user within six hours."""
    s = samples(spark, sf)
    left = s.where("event_type = 'purchase'").select("event_id", "sensor", "t")
    right = s.where("event_type = 'error'").select("sensor", F.col("t").alias("error_t"), F.col("event_id").alias("error_id"))
    out = pairing.nearest(left, right, ["sensor"], "t", "error_t", 6 * 3600.0, "error_id", "event_id")
    return out.select("event_id", F.coalesce("error_id", F.lit(-1).cast("long")).alias("error_id"), *_r("distance", digits=3))


def scored_anchors(spark, sf):
    """Each click with the sign-up that has the least score of time and place in its user's series, else the nearest place."""
    s = samples(spark, sf)
    rows = s.where("event_type = 'click'").select("sensor", F.col("n").alias("i"), F.col("t").alias("start"), (F.col("t") + 600).alias("end"))
    anchors = s.where("event_type = 'signup'").select("sensor", F.col("n").alias("j"), F.col("t").alias("at"))
    out = pairing.scored_anchor(rows, anchors, ["sensor"], 12, 5.0)
    return out.select("sensor", "i", "j", *_r("score", digits=3), "in_reach")


def inferred_windows(spark, sf):
    """Clicks known by minute and second only, and ten minutes from them on, in the hours that the sign-ups around them give."""
    s = samples(spark, sf)
    clock = lambda t: F.format_string("%02d:%02d.0", F.floor(t / 60).cast("long") % 60, F.floor(t).cast("long") % 60)
    rows = s.where("event_type = 'click'").select("sensor", F.col("n").alias("i"), clock(F.col("t")).alias("start_raw"), clock(F.col("t") + 600).alias("end_raw"))
    anchors = s.where("event_type = 'signup'").select("sensor", F.col("n").alias("j"), F.col("t").alias("at"))
    return pairing.infer_windows(rows, anchors, ["sensor"]).select("sensor", "i", "j", *_r("start", "end", "duration", "score", digits=3), "in_reach")


def containment(spark, sf):
    """Windows of a week of each dyad with how many members' recordings contain them."""
    s = samples(spark, sf)
    rec = s.groupBy("sensor").agg(F.min("t").alias("first"), F.max("t").alias("last")).withColumn("dyad", F.floor(F.col("sensor") / 2).cast("long"))
    base = rec.groupBy("dyad").agg(F.min("first").alias("t0"))
    w = base.select("dyad", F.posexplode(F.array(*[F.lit(i) for i in range(9)])).alias("candidate_window", "i"), "t0")
    w = w.select("dyad", F.col("candidate_window").cast("long").alias("candidate_window"), (F.col("t0") + F.col("i") * 259200.0).alias("start"), (F.col("t0") + F.col("i") * 259200.0 + 604800).alias("end"))
    out = pairing.coverage(w, rec, "dyad", "candidate_window")
    return out.select("dyad", "candidate_window", "covered_sensor_count", "usable")


def range_cut(spark, sf):
    """Samples within each user's window from the first purchase, three days, both ends included."""
    s = samples(spark, sf)
    w = s.where("event_type = 'purchase'").groupBy("sensor").agg(F.min("t").alias("start")).withColumn("end", F.col("start") + 259200.0)
    return pairing.range_cut(s, w, "sensor").groupBy("sensor").agg(F.count("*").alias("n"), rounded(F.avg("x")).alias("mean_x"))


def position_pairs(spark, sf):
    """Intervals of both members of a dyad paired by place."""
    rr = series.intervals(readings(spark, sf), ["sensor"]).withColumn("dyad", F.floor(F.col("sensor") / 2).cast("long"))
    a = rr.where("sensor % 2 = 0").select("dyad", "interval_number", F.col("rr_ms").alias("a"))
    b = rr.where("sensor % 2 = 1").select("dyad", "interval_number", F.col("rr_ms").alias("b"))
    out = a.join(b, ["dyad", "interval_number"]).groupBy("dyad").agg(F.count("*").alias("n"), pearson(F.col("a"), F.col("b")).alias("r"))
    return out.select("dyad", "n", *_r("r"))


def unmatched(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return pairing.unmatched(c, o, ["c_custkey"]).select("c_custkey", "c_mktsegment")


def nearest_mean(spark, sf):
    """Each nation with the market segment whose median balance is nearest, within a limit."""
    c = table(spark, sf, "customer")
    medians = quantiles(c, ["c_mktsegment"], ["c_acctbal"], [0.5]).select("c_mktsegment", F.col("value").alias("median"))
    means = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"))
    # five segments and 25 nations: both sides are of fixed size
    met = means.crossJoin(F.broadcast(medians)).withColumn("off", F.abs(F.col("mean") - F.col("median")))
    best = met.groupBy("c_nationkey").agg(F.min(F.struct("off", "c_mktsegment")).alias("x"))
    return best.select("c_nationkey", F.when(F.col("x.off") <= 250, F.col("x.c_mktsegment")).alias("segment"), rounded(F.col("x.off"), 4).alias("off"))


def greedy_matching(spark, sf):
    """Sessions of a day matched one to one: sign-ups to purchases by time."""
    s = samples(spark, sf).withColumn("day", F.floor(F.col("t") / 86400).cast("long"))
    a = s.where("event_type = 'signup'").select("day", F.col("event_id").alias("left"), F.col("t").alias("ta"))
    b = s.where("event_type = 'purchase'").select("day", F.col("event_id").alias("right"), F.col("t").alias("tb"))
    out = pairing.greedy_nearest(a, b, ["day"], 7200.0)
    return out.select("day", "left", "right", *_r("score", digits=3), "shared")


def _sessions(spark, sf):
    """Orders as recording sessions, and every third as metadata with typos in dates and sensors."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("session"), "o_custkey", seconds("o_orderdate").alias("t"))
    day = lambda t: F.date_format(F.timestamp_seconds(t.cast("long")), "yyyy/MM/dd")
    pair = lambda k: F.array((k % 97).cast("string"), (k % 89).cast("string"))
    a = o.select("session", day(F.col("t")).alias("date"), (F.col("session") * 61 % 86400).cast("double").alias("second"), pair(F.col("session")).alias("suffixes"))
    b = o.where("session % 3 = 0").select(
        (F.col("session") + 1_000_000_000).alias("dyad"), day(F.when(F.col("session") % 9 == 0, F.col("t") + 86400).otherwise(F.col("t"))).alias("date"),
        (F.floor(F.col("session") * 61 % 86400 / 3600)).cast("double").alias("hour"), F.lit(30.0).alias("minute"),
        F.when(F.col("session") % 2 == 0, pair(F.col("session"))).otherwise(F.array((F.col("session") % 97).cast("string"), F.lit("x"))).alias("suffixes"),
    )
    return a, b


def session_report(spark, sf):
    """What each session found among the metadata; those without a candidate say so."""
    a, b = _sessions(spark, sf)
    return pairing.session_summary(a, b)


def session_matching(spark, sf):
    """Sessions matched to metadata by date, sensors (suffixes) and clock time, then one to one."""
    best = matching.greedy_sessions(*_sessions(spark, sf))
    sensors = F.array(F.concat(F.lit("2514300"), (F.col("left") % 97).cast("string")), F.concat(F.lit("2514300"), (F.col("left") % 89).cast("string")))
    roles = pairing.sensor_roles(sensors, (F.col("left") % 97).cast("string"), F.when(F.col("left") % 2 == 0, (F.col("left") % 89).cast("string")).otherwise("x"))
    return best.select(F.col("left").alias("session"), F.col("right").alias("dyad"), *_r("score", digits=3), "kind", "shared", *[c.alias(k) for k, c in roles.items()])


def manifests(spark, sf):
    """Keys read off file names, files with the summary row of the same base name, and wall-clock times."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", seconds("o_orderdate").alias("t"))
    name = F.format_string("rec%d__%d__paired.csv", (F.col("o_orderkey") % 50).cast("int"), F.col("o_custkey").cast("int"))
    made = o.select("o_orderkey", "t", F.concat(F.lit("/study/in/"), F.col("o_orderkey").cast("string"), name).alias("file"))
    rows = o.where("o_orderstatus = 'F'").select(F.concat(F.lit("out/"), F.col("o_orderkey").cast("string"), name).alias("paired_file"), "o_orderstatus")
    met = files.paired_manifest(made, rows)
    keys = text.key_parts(F.col("file"))
    stamp = F.date_format(F.timestamp_seconds(F.col("t").cast("long")), "yyyy-MM-dd HH:mm")
    return met.select("o_orderkey", keys["recording_folder"].alias("folder"), keys["sensor_id"].alias("sensor"), F.coalesce("o_orderstatus", F.lit("none")).alias("status"), text.wall_clock(stamp, "America/Vancouver").alias("at"), text.time_text(stamp).alias("clock"))


# ---- aggregates


def recording_coverage(spark, sf):
    s = samples(spark, sf)
    out = summary.recording_coverage(s, ["sensor"], "t", "event_id")
    return out.select("sensor", "n_samples", "backward_jumps", "monotonic", *_r("duration", "median_step", digits=3))


def status_rollup(spark, sf):
    """Status of each dyad from its members' recordings: views stand for ECG, clicks and sign-ups for the other files."""
    s = samples(spark, sf).withColumn("dyad", F.floor(F.col("sensor") / 2).cast("long")).withColumn("file", F.col("event_type"))
    has = lambda kind, least: F.count_if((F.col("file") == kind) & (F.col("x") > least)) > 0
    span = F.max(F.when(F.col("file") == "view", F.col("t"))) - F.min(F.when(F.col("file") == "view", F.col("t")))
    rec = s.groupBy("dyad", "sensor").agg(has("view", 0).alias("ecg"), has("click", 60).alias("acc"), has("signup", 20).alias("euler"), span.alias("duration"))
    noted = s.where("file = 'error' and x > 60").select("dyad")
    out = summary.session_status(rec, "dyad", noted, dropout=86400.0)
    return out.select("dyad", "n_sensors", "sensors", "all_ecg", "all_acc", "all_euler", "annotation", "possible_dropout", *_r("min_duration", "max_duration", "duration_range", digits=3), "status", "notes")


def condition_summary(spark, sf):
    d = summary.describe(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    return d.select("l_returnflag", "n", *_r("l_quantity_mean", "l_quantity_sd", "l_quantity_median", "l_extendedprice_mean", "l_extendedprice_sd", "l_extendedprice_median", digits=4), "l_quantity_n", "l_extendedprice_n")


def label_counts(spark, sf):
    """Outer union of keys over two tables of labels, a count of each."""
    s = samples(spark, sf)
    kinds = ["view", "click", "error"]
    a = s.where("x < 40").groupBy("sensor").agg(F.count("*").alias("low_n"), *[F.count_if(F.col("event_type") == k).alias(f"low_{k}") for k in kinds], F.min("x").alias("low_min"))
    b = s.where("x > 200").groupBy("sensor").agg(F.count("*").alias("high_n"), *[F.count_if(F.col("event_type") == k).alias(f"high_{k}") for k in kinds])
    out = a.join(b, "sensor", "full")
    counts = [c for c in out.columns if c not in ("sensor", "low_min")]
    return out.select("sensor", "low_min", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])


def dyad_flags(spark, sf):
    t = _trials(spark, sf)
    per = t.groupBy("sensor", "trial").agg(F.stddev_samp("x").alias("sd"), F.count("*").alias("n"))
    flag = F.when(F.col("n") < 20, F.lit(None)).when(F.col("sd") > 60, "poor").when(F.col("sd") > 45, "caution").otherwise("clean")
    per = per.withColumn("flag", flag).withColumn("dyad", F.floor(F.col("sensor") / 2).cast("long"))
    return per.groupBy("dyad", "trial").agg(summary.dyad_flag(F.col("flag")).alias("flag"), summary.dyad_flag(F.col("flag"), strict=True).alias("strict_flag"))


def qc_funnel(spark, sf):
    s = samples(spark, sf)
    return summary.funnel(s, "event_type", [("all", F.lit(True)), ("plausible", F.col("x").between(30, 300)), ("main", F.col("x").between(40, 200)), ("early", F.col("n") <= 30)])


def metric_correlations(spark, sf):
    li = table(spark, sf, "lineitem")
    return summary.correlations(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("x", "y", *_r("r"))


def value_counts(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_distinct(F.floor(F.col("value"))).alias("n_values"))


def pretrial_quality(spark, sf):
    """Objective flags of each recording's first ten days."""
    s = samples(spark, sf)
    first = s.groupBy("sensor").agg(F.min("t").alias("start")).withColumn("end", F.col("start") + 864000.0)
    cut = pairing.range_cut(s, first, "sensor")
    q = summary.segment_summary(cut, ["sensor"], F.col("x"), "t", target=864000.0).withColumn("n_rr", F.col("n") - 1)
    flag, why = summary.pretrial_quality()
    return q.select("sensor", flag.alias("flag"), why.alias("reasons"))


def trial_quality(spark, sf):
    d = dyads(spark, sf).withColumn("a", F.when(F.col("a") < 250, F.col("a")))
    return summary.trial_quality(d, ["dyad", "trial"]).select("dyad", F.col("trial").cast("long").alias("trial"), "n", "flag", "reasons")


def dyad_reliability(spark, sf):
    rr = series.intervals(readings(spark, sf), ["sensor"])
    oe = summary.odd_even(rr, ["sensor"], "rr_ms", "interval_number", 30).withColumn("dyad", F.floor(F.col("sensor") / 2).cast("long"))
    pair = oe.groupBy("dyad").agg(F.max(F.when(F.col("sensor") % 2 == 0, F.col("r"))).alias("a"), F.max(F.when(F.col("sensor") % 2 == 1, F.col("r"))).alias("b"))
    made = summary.dyad_reliability(F.col("a"), F.col("b"))
    return pair.select("dyad", rounded(made["r_min"]).alias("r_min"), rounded(made["r_mean"]).alias("r_mean"), made["label"].alias("label"))


def reliability_strata(spark, sf):
    """Each row lands in every stratum that it belongs to."""
    s = samples(spark, sf)
    strata = F.array_compact(F.array(F.lit("all"), F.when(F.col("x").between(40, 200), "main"), F.when(F.col("event_type") == "view", "views"), F.when((F.col("event_type") == "view") & F.col("x").between(40, 200), "main_views")))
    return s.withColumn("stratum", F.explode(strata)).groupBy("stratum").agg(F.count("*").alias("n"), F.count_distinct("sensor").alias("n_sensors"), rounded(F.avg("x")).alias("mean_x"))


def analysis_units(spark, sf):
    """Rows folded two at a time, roles unpivoted, conditions looked up by trial."""
    s = samples(spark, sf)
    nxt = s.withColumn("partner", F.lead("event_id").over(series.Window.partitionBy("sensor").orderBy("n"))).where("n % 2 = 1")
    nxt = nxt.withColumn("trial", F.floor(F.col("n") / 2).cast("long")).withColumn("order", F.when(F.col("sensor") % 2 == 0, "ff-fe-ee").otherwise("fe - ff"))
    out = nxt.select("sensor", "trial", F.expr("stack(2, 'A', event_id, 'B', partner) AS (role, event_id)"), text.condition_of(F.col("order"), F.col("trial")).alias("condition"))
    return out.where("event_id is not null")


def top_samples(spark, sf):
    """Largest three values a user, ties by place: top-n by group."""
    s = samples(spark, sf)
    w = series.Window.partitionBy("sensor").orderBy(F.col("x").desc(), "n")
    return s.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("sensor", "place", "event_id", "x")


def ordered_flags(spark, sf):
    """The hundred first recordings by severity (poor, caution, clean) and sensor, with their place: a top-k report."""
    q = pretrial_quality(spark, sf)
    w = series.Window.orderBy("level", "sensor")
    top = trial.ordered(q, F.col("flag"), ["poor", "caution", "clean"], F.col("sensor"), most=100)
    # of the hundred rows left
    top = top.withColumn("level", F.array_position(F.array(*map(F.lit, ("poor", "caution", "clean"))), F.col("flag")))
    return top.withColumn("place", F.row_number().over(w).cast("long")).select("place", "sensor", "flag")


def set_operations(spark, sf):
    """Users with purchases only, errors only, or both."""
    s = samples(spark, sf).where("x > 120")
    a, b = (s.where(F.col("event_type") == k).select("sensor").distinct() for k in ("purchase", "error"))
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.exceptAll(b).withColumn("kind", F.lit("purchase"))).union(b.exceptAll(a).withColumn("kind", F.lit("error")))


# ---- scalar functions


def identifiers(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.col("c_custkey"), F.lit(".0"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.col("c_custkey"), F.lit("E+3"))).when(F.col("c_custkey") % 4 == 2, F.lit(" nan ")).otherwise(F.concat(F.lit(" "), F.col("c_custkey"), F.lit(" ")))
    return c.select("c_custkey", text.identifier(raw).alias("id"), text.safe_name(F.col("c_name")).alias("safe"), text.safe_name(F.concat(F.lit("."), F.col("c_name"), F.lit("##")), keep_dots=True).alias("safe_dots"))


def flags(spark, sf):
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, " Yes ").when(F.col("o_orderkey") % 5 == 1, "1.0").when(F.col("o_orderkey") % 5 == 2, "T").when(F.col("o_orderkey") % 5 == 3, "no")
    return o.select("o_orderkey", text.truth(raw).alias("plain"), text.truth(raw, numeric=True).alias("numeric"), text.number(raw).alias("number"), text.says_any(F.col("o_orderpriority"), ["urgent", "HIGH"]).alias("urgent"), text.joined(raw, F.lit(" "), F.col("o_orderstatus")).alias("joined"))


def participants(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("P"), F.col("c_custkey"), F.lit(" , 7"))).when(F.col("c_custkey") % 3 == 1, F.lit("2013-05-01 00:00:00")).otherwise(F.lit("Confederate"))
    cell = text.participant_cell(raw)
    return c.select("c_custkey", F.coalesce(cell["participant"], F.lit(-1)).cast("long").alias("participant"), cell["suffix"].alias("suffix"), cell["confederate"].alias("confederate"), text.dyad_id(F.col("c_custkey") % 90, F.col("c_nationkey")).alias("dyad"), text.segment_name(F.col("c_nationkey"), F.col("c_custkey") % 9).alias("segment"))


def clock_times(spark, sf):
    """Local text, folder times, minutes near an anchor, clock distances."""
    o = table(spark, sf, "orders").select("o_orderkey", seconds("o_orderdate").alias("t"))
    o = o.withColumn("t", F.col("t") + (F.col("o_orderkey") % 86400))
    mmss = F.format_string("%02d:%04.1f", ((F.col("o_orderkey") * 7) % 60).cast("int"), ((F.col("o_orderkey") % 600) / 10).cast("double"))
    return o.select(
        "o_orderkey",
        text.local_text(F.col("t"), "America/Vancouver").alias("local"),
        text.minute_near(mmss, F.col("t")).alias("near"),
        text.clock_distance((F.col("o_orderkey") % 12).cast("double"), F.lit(30.0), F.col("t") % 86400).alias("off"),
        text.folder_time(F.date_format(F.timestamp_seconds(F.col("t").cast("long")), "yyyy_MM_dd-HH_mm_ss")).alias("folder_t"),
        text.date_text(F.when(F.col("o_orderkey") % 2 == 0, F.date_format(F.timestamp_seconds(F.col("t").cast("long")), "yyyy-MM-dd")).otherwise("pilot")).alias("day"),
    )


def rates(spark, sf):
    """Sampling rate from a title or from times."""
    s = samples(spark, sf)
    w = series.Window.partitionBy("sensor").orderBy("t")
    m = s.withColumn("d", F.col("t") - F.lag("t").over(w)).groupBy("sensor").agg((1e6 / F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(0.5))).alias("fs"))
    title = F.concat(F.lit("Sensor 7 at "), F.round(F.col("fs") * 1.05, 1).cast("string"), F.lit(" Hz"))
    return m.select("sensor", rounded(text.sampling_rate(F.when(F.col("sensor") % 2 == 0, title), F.col("fs")), 3).alias("rate"))


NAMES = (
    enrichment, flag_lookup, two_stage_lookup, nearest_session, scored_anchors, inferred_windows, containment, range_cut, position_pairs, unmatched,
    nearest_mean, greedy_matching, session_matching, session_report, manifests, recording_coverage, status_rollup, condition_summary, label_counts, dyad_flags, qc_funnel,
    metric_correlations, value_counts, pretrial_quality, trial_quality, dyad_reliability, reliability_strata, analysis_units,
    top_samples, ordered_flags, set_operations, identifiers, flags, participants, clock_times, rates,
)
QUERIES = {f.__name__: f for f in NAMES}


def _why(cases: list[tuple[str, str]], sep: str) -> str:
    return "concat_ws('" + sep + "', " + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for c, name in cases) + ")"


_PRE = [
    ("p", "d IS NULL OR d < 60", "less_than_60s_hr_available"), ("c", "d >= 60 AND (d < 100 OR cov < 80)", "short_or_incomplete_pretrial_hr_coverage"),
    ("p", "n - 1 < 30", "too_few_rr_intervals"), ("p", "pl < 90", "rr_plausible_percent_below_90"), ("c", "pl >= 90 AND pl < 95", "rr_plausible_percent_90_to_95"),
    ("p", "ex > 5", "extreme_hr_percent_above_5"), ("c", "ex > 0.5 AND ex <= 5", "some_extreme_hr_values"), ("p", "lo < 30", "minimum_hr_below_30"),
    ("c", "lo >= 30 AND lo < 40", "minimum_hr_below_40"), ("p", "hi > 220", "maximum_hr_above_220"), ("c", "hi > 200 AND hi <= 220", "maximum_hr_above_200"),
    ("p", "sd > 30", "hr_sd_above_30"), ("c", "sd > 20 AND sd <= 30", "hr_sd_20_to_30"), ("p", "hi - lo > 150", "hr_range_above_150"), ("c", "hi - lo > 100 AND hi - lo <= 150", "hr_range_100_to_150"),
]
_TRI = [
    x for r in "AB" for x in (
        ("p", f"cov{r} < 0.8", f"HR_{r}_coverage_below_0.80"), ("c", f"cov{r} >= 0.8 AND cov{r} < 0.95", f"HR_{r}_coverage_below_0.95"),
        ("p", f"lo{r} < 30", f"HR_{r}_min_below_30"), ("c", f"lo{r} >= 30 AND lo{r} < 40", f"HR_{r}_min_below_40"),
        ("p", f"hi{r} > 220", f"HR_{r}_max_above_220"), ("c", f"hi{r} > 200 AND hi{r} <= 220", f"HR_{r}_max_above_200"),
        ("p", f"sev{r} > 0", f"HR_{r}_severe_extreme_values_present"), ("p", f"sev{r} = 0 AND ext{r} > 0.05", f"HR_{r}_extreme_fraction_above_0.05"),
        ("c", f"sev{r} = 0 AND ext{r} > 0.005 AND ext{r} <= 0.05", f"HR_{r}_extreme_fraction_above_0.005"), ("p", f"lo{r} IS NULL", f"HR_{r}_all_missing"))
]


def _flag(rules: list[tuple[str, str, str]]) -> str:
    hit = {k: " OR ".join(f"coalesce({c}, false)" for kind, c, _ in rules if kind == k) for k in "pc"}
    return f"CASE WHEN {hit['p']} THEN 'poor' WHEN {hit['c']} THEN 'caution' ELSE 'clean' END"


#: Sessions (a), metadata (b) and scored candidates (cand) in SQL.
SESSIONS = """o AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders),
        a AS (SELECT k, strftime(d, '%Y/%m/%d') AS day, (k * 61 % 86400)::DOUBLE AS sec, list_sort(list_distinct([(k % 97)::VARCHAR, (k % 89)::VARCHAR])) AS s FROM o),
        b AS (SELECT k + 1000000000 AS dyad, strftime(CASE WHEN k % 9 = 0 THEN d + INTERVAL 1 DAY ELSE d END, '%Y/%m/%d') AS day, k * 61 % 86400 // 3600 AS h,
                     list_sort(list_distinct([(k % 97)::VARCHAR, CASE WHEN k % 2 = 0 THEN (k % 89)::VARCHAR ELSE 'x' END])) AS s FROM o WHERE k % 3 = 0),
        met AS (SELECT a.k, dyad, a.day = b.day AS same, true AS exact, h, sec FROM a JOIN b ON a.s = b.s
          UNION ALL SELECT DISTINCT x.k, y.dyad, true, false, h, sec FROM (SELECT *, unnest(s) AS one FROM a) x JOIN (SELECT *, unnest(s) AS one FROM b) y ON x.day = y.day AND x.one = y.one WHERE x.s <> y.s),
        far AS (SELECT *, CASE WHEN h BETWEEN 1 AND 6 THEN least(abs(h * 3600.0 + 1800 - sec), abs((h + 12) * 3600.0 + 1800 - sec)) ELSE abs(h * 3600.0 + 1800 - sec) END::DOUBLE AS off FROM met),
        cand AS (SELECT k, dyad, CASE WHEN same AND exact THEN 'same_date_exact_sensors' WHEN same THEN 'same_date_partial_sensor_time_close' ELSE 'date_mismatch_exact_sensors_time_close' END AS kind,
                        off + CASE WHEN same AND exact THEN 0 WHEN same THEN 500 ELSE 2000 END AS score FROM far WHERE ((same AND exact) OR off <= 1200))"""

ORACLES = {
    "enrichment": """WITH f AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)
        SELECT o_orderstatus, count(*) AS n, count(q) AS n_found, round(sum(q), 2) AS quantity FROM lineitem LEFT JOIN f USING (l_orderkey, l_suppkey)
        LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderstatus""",
    "flag_lookup": f"""WITH {SAMPLES}, f AS (SELECT sensor + 1 AS sensor, arg_max(event_type, t) AS flag FROM samples WHERE event_type IN ('error', 'signup') GROUP BY sensor)
        SELECT sensor, coalesce(flag, 'missing') AS flag, count(*) AS n FROM samples LEFT JOIN f USING (sensor) GROUP BY ALL""",
    "two_stage_lookup": """SELECT c_custkey, coalesce(s.s_acctbal, k.b) AS value, CASE WHEN s.s_acctbal IS NOT NULL THEN 'name' WHEN k.b IS NOT NULL THEN 'key' ELSE 'none' END AS source
        FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) s ON c_name = replace(s_name, 'Supplier', 'Customer')
        LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS b FROM supplier GROUP BY ALL) k ON c_nationkey = k.s_nationkey""",
    "nearest_session": f"""WITH {SAMPLES}, m AS (SELECT p.event_id, e.event_id AS error_id, abs(p.t - e.t) AS d FROM samples p JOIN samples e ON p.sensor = e.sensor AND e.event_type = 'error'
          AND abs(p.t - e.t) <= 21600 WHERE p.event_type = 'purchase'), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, error_id) = 1)
        SELECT s.event_id, coalesce(error_id, -1) AS error_id, round(d, 3) AS distance FROM samples s LEFT JOIN b USING (event_id) WHERE s.event_type = 'purchase'""",
    "scored_anchors": f"""WITH {SAMPLES}, m AS (
          SELECT c.sensor, c.n AS i, a.n AS j, least(abs(a.t - c.t), abs(a.t - (c.t + 600))) + 5.0 * abs(c.n - a.n) AS score, abs(c.n - a.n) AS off FROM samples c JOIN samples a ON a.sensor = c.sensor
          WHERE c.event_type = 'click' AND a.event_type = 'signup')
        SELECT sensor, i, j, round(score::DOUBLE, 3) AS score, off <= 12 AS in_reach FROM m
        QUALIFY row_number() OVER (PARTITION BY sensor, i ORDER BY off > 12, CASE WHEN off <= 12 THEN score ELSE off END, j) = 1""",
    # an hour is a click's if it brings it nearest to the sign-up; of two the earlier
    "inferred_windows": f"""WITH {SAMPLES}, c AS (SELECT sensor, n AS i, floor(t)::BIGINT % 3600 AS ms, (floor(t)::BIGINT + 600) % 3600 AS me FROM samples WHERE event_type = 'click'),
        m AS (SELECT c.*, a.n AS j, a.t AS q, floor(a.t / 3600) * 3600 + ms AS bs, floor(a.t / 3600) * 3600 + me AS be, abs(i - a.n) AS off FROM c JOIN samples a ON a.sensor = c.sensor AND a.event_type = 'signup'),
        h AS (SELECT *, bs + CASE WHEN bs - q >= 1800 THEN -3600 WHEN bs - q < -1800 THEN 3600 ELSE 0 END AS s, be + CASE WHEN be - q >= 1800 THEN -3600 WHEN be - q < -1800 THEN 3600 ELSE 0 END AS e0 FROM m),
        t AS (SELECT *, CASE WHEN e0 < s THEN e0 + 3600 ELSE e0 END AS e FROM h), k AS (SELECT *, least(abs(q - s), abs(q - e)) + 5.0::DOUBLE * off AS score FROM t),
        best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY sensor, i ORDER BY off > 12, CASE WHEN off <= 12 THEN score ELSE off END, j) = 1)
        SELECT c.sensor, c.i, j, round(s, 3) AS start, round(e, 3) AS "end", round(e - s, 3) AS duration, round(score, 3) AS score, off <= 12 AS in_reach FROM c LEFT JOIN best b ON b.sensor = c.sensor AND b.i = c.i""",
    "greedy_matching": f"""WITH RECURSIVE {SAMPLES}, s AS (SELECT floor(t / 86400)::BIGINT AS day, event_id, event_type, t FROM samples),
        met AS (SELECT a.day, a.event_id AS l, b.event_id AS r, abs(a.t - b.t) AS score FROM s a JOIN s b ON b.day = a.day AND abs(a.t - b.t) <= 7200 WHERE a.event_type = 'signup' AND b.event_type = 'purchase'),
        lefts AS (SELECT day, l, row_number() OVER (PARTITION BY day ORDER BY l) AS k, list(struct_pack(score := score, r := r) ORDER BY score, r) AS c FROM met GROUP BY day, l),
        step AS (SELECT day, 0::BIGINT AS k, NULL::BIGINT AS l, []::BIGINT[] AS taken, NULL::STRUCT(score DOUBLE, r BIGINT) AS pick, false AS shared FROM (SELECT DISTINCT day FROM lefts)
          UNION ALL SELECT day, k, l, list_append(taken, coalesce(free[1], c[1]).r), coalesce(free[1], c[1]), len(free) = 0 FROM (
            SELECT x.day, x.k, x.l, x.c, t.taken, list_filter(x.c, lambda z: NOT list_contains(t.taken, z.r)) AS free FROM step t JOIN lefts x ON x.day = t.day AND x.k = t.k + 1))
        SELECT day, l AS left, pick.r AS right, round(pick.score, 3) AS score, shared FROM step WHERE l IS NOT NULL""",
    # each left asks for its next best right until none of lower number asks for the same
    "session_matching": f"""WITH RECURSIVE {SESSIONS},
        c AS (SELECT k AS l, dyad AS r, score, kind, row_number() OVER (PARTITION BY k ORDER BY score, dyad) AS p FROM cand),
        step AS (SELECT 0 AS round, l, 1::BIGINT AS p FROM (SELECT DISTINCT l FROM c)
          UNION ALL SELECT round + 1, l, p + lose FROM (SELECT *, sum(lose) OVER () AS losers FROM (
            SELECT s.round, s.l, s.p, CASE WHEN c.r IS NOT NULL AND s.l > min(s.l) OVER (PARTITION BY c.r) THEN 1 ELSE 0 END AS lose
            FROM step s LEFT JOIN c ON c.l = s.l AND c.p = s.p)) WHERE losers > 0),
        last AS (SELECT s.l, coalesce(c.p, 1) AS p, c.p IS NULL AS shared FROM step s LEFT JOIN c ON c.l = s.l AND c.p = s.p WHERE round = (SELECT max(round) FROM step)),
        picks AS (SELECT l, struct_pack(score := score, r := r, kind := kind) AS pick, shared FROM last JOIN c USING (l, p)),
        roles AS (SELECT l, pick, shared, ['2514300' || l % 97, '2514300' || l % 89] AS ids, (l % 97)::VARCHAR AS sa, CASE WHEN l % 2 = 0 THEN (l % 89)::VARCHAR ELSE 'x' END AS sb FROM picks),
        ends AS (SELECT *, coalesce(list_filter(ids, lambda z: ends_with(z, sa))[-1], '') AS a, coalesce(list_filter(ids, lambda z: ends_with(z, sb))[-1], '') AS b FROM roles),
        rest AS (SELECT *, CASE WHEN b = '' AND a <> '' AND len(list_filter(ids, lambda z: z <> a)) = 1 THEN list_filter(ids, lambda z: z <> a)[1] END AS rb FROM ends)
        SELECT l AS session, pick.r AS dyad, round(pick.score, 3) AS score, pick.kind AS kind, shared, a AS sensor_a, coalesce(rb, b) AS sensor_b,
               concat_ws(' ', CASE WHEN rb IS NOT NULL THEN 'Inferred sensor_B as remaining folder sensor.' END, CASE WHEN coalesce(rb, b) = '' THEN 'Could not resolve sensor_B.' END) AS note FROM rest""",
    "session_report": f"""WITH {SESSIONS}, best AS (SELECT k, count(*) AS n, arg_min(kind, struct_pack(s := score, d := dyad)) AS kind FROM cand GROUP BY k)
        SELECT a.k AS session, coalesce(n, 0) AS n_candidates, kind AS best,
               CASE WHEN n IS NULL THEN 'No candidate metadata row matched date/time/sensors.' ELSE '' END AS issue FROM a LEFT JOIN best ON best.k = a.k""",
    "manifests": """WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus, date_trunc('minute', o_orderdate) AS d FROM orders)
        SELECT o_orderkey, o_orderkey::VARCHAR || 'rec' || o_orderkey % 50 AS folder, o_custkey::VARCHAR AS sensor, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'none' END AS status,
               epoch(d::TIMESTAMP AT TIME ZONE 'America/Vancouver')::DOUBLE AS at, strftime(d, '%H:%M') AS clock FROM b""",
    "containment": f"""WITH {SAMPLES}, r AS (SELECT sensor, sensor // 2 AS dyad, min(t) AS f, max(t) AS l FROM samples GROUP BY sensor),
        w AS (SELECT dyad, i AS candidate_window, f + i * 259200.0::DOUBLE AS s, f + i * 259200.0::DOUBLE + 604800 AS e FROM (SELECT dyad, min(f) AS f FROM r GROUP BY dyad), range(0, 9) AS g(i))
        SELECT w.dyad, candidate_window, count(*) FILTER (r.f <= s AND r.l >= e) AS covered_sensor_count, count(*) FILTER (r.f <= s AND r.l >= e) >= 2 AS usable FROM w JOIN r USING (dyad) GROUP BY ALL""",
    "range_cut": f"""WITH {SAMPLES}, w AS (SELECT sensor, min(t) AS s FROM samples WHERE event_type = 'purchase' GROUP BY sensor)
        SELECT sensor, count(*) AS n, round(avg(x), 6) AS mean_x FROM samples JOIN w USING (sensor) WHERE t BETWEEN s AND s + 259200 GROUP BY sensor""",
    "position_pairs": f"""WITH {SAMPLES}, rr AS (SELECT sensor, n, (lead(t) OVER (PARTITION BY sensor ORDER BY n) - t) * 1000 AS rr FROM samples),
        p AS (SELECT a.sensor // 2 AS dyad, a.rr AS a, b.rr AS b FROM rr a JOIN rr b ON b.sensor = a.sensor + 1 AND a.n = b.n WHERE a.sensor % 2 = 0 AND a.rr IS NOT NULL AND b.rr IS NOT NULL)
        SELECT dyad, count(*) AS n, round({r_sql("a", "b")}, 6) AS r FROM p GROUP BY dyad""",
    "unmatched": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "nearest_mean": """WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY ALL), a AS (SELECT c_nationkey, avg(c_acctbal) AS a FROM customer GROUP BY ALL)
        SELECT c_nationkey, CASE WHEN abs(a - m) <= 250 THEN c_mktsegment END AS segment, round(abs(a - m), 4) AS off FROM a, m
        QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(a - m), c_mktsegment) = 1""",
    "recording_coverage": f"""WITH {SAMPLES}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY sensor ORDER BY event_id) AS d FROM samples)
        SELECT sensor, count(t) AS n_samples, count(*) FILTER (d < 0) AS backward_jumps, count(*) FILTER (d < 0) = 0 AS monotonic, round(max(t) - min(t), 3) AS duration,
               round(median(CASE WHEN d > 0 THEN d END), 3) AS median_step FROM d GROUP BY sensor""",
    "status_rollup": f"""WITH {SAMPLES}, r AS (SELECT sensor // 2 AS dyad, sensor, bool_or(event_type = 'view' AND x > 0) AS ecg, bool_or(event_type = 'click' AND x > 60) AS acc,
          bool_or(event_type = 'signup' AND x > 20) AS euler, max(t) FILTER (event_type = 'view') - min(t) FILTER (event_type = 'view') AS d FROM samples GROUP BY ALL),
        n AS (SELECT DISTINCT sensor // 2 AS dyad FROM samples WHERE event_type = 'error' AND x > 60),
        s AS (SELECT dyad, count(*) AS n_sensors, string_agg(sensor::VARCHAR, ';' ORDER BY sensor::VARCHAR) AS sensors, bool_or(ecg OR acc OR euler) AS has_any, bool_and(ecg) AS all_ecg, bool_and(acc) AS all_acc,
          bool_and(euler) AS all_euler, dyad IN (SELECT dyad FROM n) AS annotation, coalesce(max(d) - min(d) > 86400, false) AS possible_dropout, min(d) AS lo, max(d) AS hi FROM r GROUP BY dyad),
        k AS (SELECT *, CASE WHEN NOT has_any THEN 'empty_folder' WHEN n_sensors <> 2 THEN 'check_sensor_count' WHEN NOT all_ecg THEN 'missing_ecg' WHEN NOT (all_acc AND all_euler) THEN 'missing_non_ecg_file'
          WHEN NOT annotation THEN 'missing_annotation' ELSE 'complete' END AS status FROM s)
        SELECT dyad, n_sensors, sensors, all_ecg, all_acc, all_euler, annotation, possible_dropout, round(lo, 3) AS min_duration, round(hi, 3) AS max_duration, round(hi - lo, 3) AS duration_range, status,
          CASE status WHEN 'empty_folder' THEN 'Sensor folders exist, but no ECG/Acc/Euler files were found.' WHEN 'check_sensor_count' THEN 'Expected 2 sensor folders, found ' || n_sensors || '.'
            WHEN 'missing_ecg' THEN 'At least one sensor is missing ECG.' WHEN 'missing_non_ecg_file' THEN 'At least one sensor is missing Acc or EulerAngles.' WHEN 'missing_annotation' THEN 'Annotation file is missing.'
            ELSE 'Complete raw sensor file set found.' END || CASE WHEN possible_dropout THEN ' ECG duration range suggests possible dropout.' ELSE '' END AS notes FROM k""",
    "condition_summary": """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS l_quantity_mean, round(stddev_samp(l_quantity), 4) AS l_quantity_sd, median(l_quantity) AS l_quantity_median,
        round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_sd, round(median(l_extendedprice), 4) AS l_extendedprice_median,
        count(l_quantity) AS l_quantity_n, count(l_extendedprice) AS l_extendedprice_n FROM lineitem GROUP BY l_returnflag""",
    "label_counts": f"""WITH {SAMPLES}, a AS (SELECT sensor, count(*) AS low_n, count(*) FILTER (event_type = 'view') AS low_view, count(*) FILTER (event_type = 'click') AS low_click,
          count(*) FILTER (event_type = 'error') AS low_error, min(x) AS low_min FROM samples WHERE x < 40 GROUP BY sensor),
        b AS (SELECT sensor, count(*) AS high_n, count(*) FILTER (event_type = 'view') AS high_view, count(*) FILTER (event_type = 'click') AS high_click,
          count(*) FILTER (event_type = 'error') AS high_error FROM samples WHERE x > 200 GROUP BY sensor) SELECT sensor, low_min, coalesce(COLUMNS('(low|high)_(n|view|click|error)'), 0) FROM a FULL JOIN b USING (sensor)""",
    "dyad_flags": f"""WITH {_TRIALS}, p AS (SELECT sensor // 2 AS dyad, trial, CASE WHEN count(*) < 20 THEN NULL WHEN stddev_samp(x) > 60 THEN 'poor' WHEN stddev_samp(x) > 45 THEN 'caution' ELSE 'clean' END AS flag
          FROM trials GROUP BY sensor, trial)
        SELECT dyad, trial, CASE WHEN bool_or(flag = 'poor') THEN 'poor' WHEN bool_or(flag = 'caution') THEN 'caution' WHEN count(flag) > 0 THEN 'both_clean' ELSE 'incomplete' END AS flag,
          CASE WHEN bool_or(flag = 'poor') THEN 'poor' WHEN bool_or(flag = 'caution') THEN 'caution' WHEN count(flag) > 1 THEN 'both_clean' ELSE 'incomplete' END AS strict_flag FROM p GROUP BY ALL""",
    "qc_funnel": f"""WITH {SAMPLES} SELECT event_type, unnest(['all', 'plausible', 'main', 'early']) AS stage, unnest([count(*), count(*) FILTER (x BETWEEN 30 AND 300), count(*) FILTER (x BETWEEN 40 AND 200),
        count(*) FILTER (x BETWEEN 40 AND 200 AND n <= 30)]) AS n FROM samples GROUP BY event_type""",
    "metric_correlations": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round({r_sql(x, y)}, 6) AS r FROM lineitem" for i, x in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for y in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i:]) + ")",
    "value_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT floor(value)) AS n_values FROM events GROUP BY event_type",
    "pretrial_quality": f"""WITH {SAMPLES}, f AS (SELECT sensor, min(t) AS s FROM samples GROUP BY sensor), q AS (
          SELECT sensor, max(t) - min(t) AS d, least(100, (max(t) - min(t)) / 864000 * 100) AS cov, count(*) AS n, 100 * avg((60000 / x BETWEEN 300 AND 2000)::INT) AS pl,
                 100 * avg((x < 40 OR x > 200)::INT) AS ex, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd FROM samples JOIN f USING (sensor) WHERE t <= s + 864000 GROUP BY sensor)
        SELECT sensor, {_flag(_PRE)} AS flag, CASE WHEN ({_flag(_PRE)}) = 'clean' THEN 'objective_metrics_within_thresholds' ELSE {_why([x[1:] for x in _PRE], "; ")} END AS reasons FROM q""",
    "trial_quality": f"""WITH {DYADS}, q AS (SELECT dyad, trial, count(*) AS n, """ + ", ".join(
        f"count({v}) / count(*) AS cov{r}, min({v}) AS lo{r}, max({v}) AS hi{r}, avg(({v} < 40 OR {v} > 200)::INT) AS ext{r}, avg(({v} < 30 OR {v} > 220)::INT) AS sev{r}" for r, v in (("A", "a"), ("B", "b"))) + f"""
          FROM (SELECT dyad, trial, CASE WHEN a < 250 THEN a END AS a, b FROM dyads) GROUP BY ALL)
        SELECT dyad, trial, n, CASE WHEN n < 10 THEN 'poor' ELSE {_flag(_TRI)} END AS flag, CASE WHEN n < 10 THEN 'too_few_samples_n_' || n WHEN ({_flag(_TRI)}) = 'clean' THEN 'trial_segment_metrics_within_thresholds'
          ELSE {_why([x[1:] for x in _TRI], ";")} END AS reasons FROM q""",
    "dyad_reliability": f"""WITH {SAMPLES}, rr AS (SELECT sensor, n, (lead(t) OVER (PARTITION BY sensor ORDER BY n) - t) * 1000 AS rr FROM samples),
        p AS (SELECT sensor, (n - 1) // 2 AS pair, max(rr) FILTER (n % 2 = 1) AS o, max(rr) FILTER (n % 2 = 0) AS e FROM rr WHERE rr IS NOT NULL GROUP BY ALL),
        c AS (SELECT sensor, {r_sql("o", "e", 30)} AS r FROM p WHERE e IS NOT NULL GROUP BY sensor),
        d AS (SELECT sensor // 2 AS dyad, max(r) FILTER (sensor % 2 = 0) AS a, max(r) FILTER (sensor % 2 = 1) AS b FROM c GROUP BY ALL)
        SELECT dyad, round(least(a, b), 6) AS r_min, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS r_mean,
          CASE WHEN a < 0.5 OR b < 0.5 THEN 'low' WHEN a IS NULL OR b IS NULL THEN 'unavailable' WHEN a < 0.75 OR b < 0.75 THEN 'caution' ELSE 'reliable' END AS label FROM d""",
    "reliability_strata": f"""WITH {SAMPLES}, s AS (SELECT 'all' AS stratum, sensor, x FROM samples UNION ALL SELECT 'main', sensor, x FROM samples WHERE x BETWEEN 40 AND 200 UNION ALL
        SELECT 'views', sensor, x FROM samples WHERE event_type = 'view' UNION ALL SELECT 'main_views', sensor, x FROM samples WHERE event_type = 'view' AND x BETWEEN 40 AND 200)
        SELECT stratum, count(*) AS n, count(DISTINCT sensor) AS n_sensors, round(avg(x), 6) AS mean_x FROM s GROUP BY stratum""",
    "analysis_units": f"""WITH {SAMPLES}, f AS (SELECT sensor, n, event_id, lead(event_id) OVER (PARTITION BY sensor ORDER BY n) AS partner FROM samples), u AS (
          SELECT *, n // 2 AS trial, CASE WHEN sensor % 2 = 0 THEN ['FF', 'FF', 'FE', 'FE', 'EE', 'EE'] ELSE ['FE', 'FE', 'FF', 'FF'] END AS c FROM f WHERE n % 2 = 1)
        SELECT sensor, trial, role, CASE role WHEN 'A' THEN event_id ELSE partner END AS event_id, CASE WHEN trial = 0 THEN 'practice' ELSE coalesce(c[trial], 'unknown') END AS condition
        FROM u, (VALUES ('A'), ('B')) AS r(role) WHERE role = 'A' OR partner IS NOT NULL""",
    "top_samples": f"WITH {SAMPLES} SELECT sensor, row_number() OVER w AS place, event_id, x FROM samples WINDOW w AS (PARTITION BY sensor ORDER BY x DESC, n) QUALIFY place <= 3",
    "set_operations": f"""WITH {SAMPLES}, k AS (SELECT sensor, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'error') AS e FROM samples WHERE x > 120 GROUP BY sensor)
        SELECT sensor, CASE WHEN p AND e THEN 'both' WHEN p THEN 'purchase' ELSE 'error' END AS kind FROM k WHERE p OR e""",
    "identifiers": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN (c_custkey * 1000)::VARCHAR WHEN 2 THEN '' ELSE c_custkey::VARCHAR END AS id,
        regexp_replace(c_name, '[^A-Za-z0-9_-]+', '_', 'g') AS safe, '.' || regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe_dots FROM customer""",
    "flags": """SELECT o_orderkey, o_orderkey % 5 IN (0, 2) AS plain, o_orderkey % 5 IN (0, 1, 2) AS numeric, CASE WHEN o_orderkey % 5 = 1 THEN 1.0::DOUBLE END AS number,
        o_orderpriority ILIKE '%urgent%' OR o_orderpriority ILIKE '%high%' AS urgent, CASE o_orderkey % 5 WHEN 0 THEN 'Yes | ' WHEN 1 THEN '1.0 | ' WHEN 2 THEN 'T | ' WHEN 3 THEN 'no | ' ELSE '' END || o_orderstatus AS joined FROM orders""",
    "participants": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN 5 ELSE -1 END AS participant, CASE c_custkey % 3 WHEN 0 THEN '7' WHEN 1 THEN '2013' END AS suffix, c_custkey % 3 = 2 AS confederate,
        format('P{:02d}_P{:02d}', c_custkey % 90, c_nationkey) AS dyad, format('cw{:02d}__trial{:02d}', c_nationkey, c_custkey % 9) AS segment FROM customer""",
    "clock_times": """WITH b AS (SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 + o_orderkey % 86400 AS t FROM orders), m AS (SELECT *, floor(t / 3600) * 3600 + ((o_orderkey * 7) % 60) * 60 + (o_orderkey % 600) / 10 AS base FROM b)
        SELECT o_orderkey, strftime(make_timestamptz((t * 1000000)::BIGINT) AT TIME ZONE 'America/Vancouver', '%Y-%m-%d %H:%M:%S') AS local,
          CASE WHEN abs(base - 3600 - t) <= abs(base - t) AND abs(base - 3600 - t) <= abs(base + 3600 - t) THEN base - 3600 WHEN abs(base - t) <= abs(base + 3600 - t) THEN base ELSE base + 3600 END AS near,
          least(abs((o_orderkey % 12) * 3600 + 1800 - t % 86400), CASE WHEN o_orderkey % 12 BETWEEN 1 AND 6 THEN abs((o_orderkey % 12 + 12) * 3600 + 1800 - t % 86400) END) AS off, t AS folder_t,
          CASE WHEN o_orderkey % 2 = 0 THEN strftime(make_timestamp((t * 1000000)::BIGINT), '%Y/%m/%d') ELSE 'pilot' END AS day FROM m""",
    "rates": f"""WITH {SAMPLES}, d AS (SELECT sensor, t - lag(t) OVER (PARTITION BY sensor ORDER BY t) AS d FROM samples), m AS (SELECT sensor, 1e6 / median(CASE WHEN d > 0 THEN d END) AS fs FROM d GROUP BY sensor),
        r AS (SELECT sensor, fs, CASE WHEN sensor % 2 = 0 THEN round(fs * 1.05, 1) END AS said FROM m)
        SELECT sensor, round(CASE WHEN said BETWEEN 20 AND 1000 AND (fs NOT BETWEEN 20 AND 1000 OR abs(said - fs) <= 0.1 * fs) THEN said WHEN fs BETWEEN 20 AND 1000 THEN fs END, 3) AS rate FROM r""",
}
ORACLES["ordered_flags"] = f"""SELECT row_number() OVER (ORDER BY list_position(['poor', 'caution', 'clean'], flag), sensor) AS place, sensor, flag
    FROM ({ORACLES["pretrial_quality"]}) QUALIFY place <= 100"""
