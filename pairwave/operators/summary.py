"""Aggregates, quality classifiers and reliability of recordings and trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pearson, reliability_label, share
from .quantiles import quantiles
from ..functions.text import reasons


def recording_coverage(samples: DataFrame, keys: list[str], t: str, place: str) -> DataFrame:
    """Samples, first and last time, duration, median positive step in file order, backward jumps, and whether monotonic."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(place))
    out = samples.withColumn("__d", step).groupBy(*keys).agg(
        F.count(t).alias("n_samples"),
        F.min(t).alias("first"),
        F.max(t).alias("last"),
        (F.max(t) - F.min(t)).alias("duration"),
        F.percentile(F.when(F.col("__d") > 0, F.col("__d")), F.lit(0.5)).alias("median_step"),
        F.count_if(F.col("__d") < 0).alias("backward_jumps"),
    )
    return out.withColumn("monotonic", F.col("backward_jumps") == 0)


# Statuses and notes of a session, in order of precedence.
SESSION_STATUSES = (
    ("empty_folder", "Sensor folders exist, but no ECG/Acc/Euler files were found."),
    ("check_sensor_count", "Expected 2 sensor folders, found %d."),
    ("missing_ecg", "At least one sensor is missing ECG."),
    ("missing_non_ecg_file", "At least one sensor is missing Acc or EulerAngles."),
    ("missing_annotation", "Annotation file is missing."),
    ("complete", "Complete raw sensor file set found."),
)


def session_status(sensors: DataFrame, session: str, annotated: DataFrame, *, dropout: float = 300.0) -> DataFrame:
    """A row a session from its sensors: session, sensor, ecg, acc, euler (files present), duration (of the ECG, or null).

    annotated: the sessions with an annotation file. n_sensors, sensors (joined in order), all_* flags, status and notes,
    possible_dropout (durations differ by more than dropout seconds), and the extremes of the durations.
    """
    d = F.col("duration")
    out = sensors.groupBy(session).agg(
        F.count("*").alias("n_sensors"),
        F.array_join(F.sort_array(F.collect_list(F.col("sensor").cast("string"))), ";").alias("sensors"),
        F.bool_or(F.col("ecg") | F.col("acc") | F.col("euler")).alias("__any"),
        *[F.bool_and(c).alias(f"all_{c}") for c in ("ecg", "acc", "euler")],
        F.min(d).alias("min_duration"), F.max(d).alias("max_duration"), (F.max(d) - F.min(d)).alias("duration_range"),
    )
    out = out.join(annotated.select(session).distinct().withColumn("__noted", F.lit(True)), session, "left")
    out = out.withColumn("annotation", F.coalesce("__noted", F.lit(False))).withColumn("possible_dropout", F.coalesce(F.col("duration_range") > dropout, F.lit(False)))
    holds = [~F.col("__any"), F.col("n_sensors") != 2, ~F.col("all_ecg"), ~(F.col("all_acc") & F.col("all_euler")), ~F.col("annotation"), F.lit(True)]
    first = lambda values: F.coalesce(*[F.when(h, v) for h, v in zip(holds, values)])
    notes = first([F.format_string(note, F.col("n_sensors")) if "%d" in note else F.lit(note) for _, note in SESSION_STATUSES])
    more = F.when(F.col("possible_dropout"), " ECG duration range suggests possible dropout.").otherwise("")
    return out.select("*", first([F.lit(k) for k, _ in SESSION_STATUSES]).alias("status"), F.concat(notes, more).alias("notes")).drop("__any", "__noted")


def segment_summary(df: DataFrame, keys: list[str], hr: Column, t: str, target: float | None = None) -> DataFrame:
    """n, mean, sample SD, extremes, range, median, shares of plausible intervals and of extreme rates, coverage.

    A rate of zero has no interval, which is not plausible; unknown rates count in no share.
    """
    rr = 60000 / F.nullif(hr, F.lit(0.0))
    spans = [F.least(F.lit(100.0), (F.max(t) - F.min(t)) / target * 100).alias("coverage_percent")] if target else []
    return df.groupBy(*keys).agg(
        F.count(hr).alias("n"),
        F.avg(hr).alias("mean_hr"),
        F.stddev_samp(hr).alias("sd_hr"),
        F.min(hr).alias("min_hr"),
        F.max(hr).alias("max_hr"),
        (F.max(hr) - F.min(hr)).alias("range_hr"),
        F.percentile(hr, F.lit(0.5)).alias("median_hr"),
        (100 * share(F.when(hr.isNotNull(), F.coalesce(rr.between(300, 2000), F.lit(False))))).alias("plausible_percent"),
        F.count_if((hr < 40) | (hr > 200)).alias("n_extreme"),
        (100 * share((hr < 40) | (hr > 200))).alias("extreme_percent"),
        (F.max(t) - F.min(t)).alias("duration"),
        *spans,
    )


def describe(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Mean, SD, median and count of each metric by key, null keys kept. Keys are few and large, so medians come by refinement."""
    made = []
    for m in metrics:
        made += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"), F.count(m).alias(f"{m}_n")]
    medians = quantiles(df, [key], metrics, [0.5]).groupBy(F.struct(key).alias("__key"))
    medians = medians.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"{m}_median") for m in metrics])
    out = df.groupBy(key).agg(F.count("*").alias("n"), *made).withColumn("__key", F.struct(key)).join(medians, "__key", "left")
    order = [f"{m}_{what}" for m in metrics for what in ("mean", "sd", "median", "n")]
    return out.select(key, "n", *order)


def correlations(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Pairwise complete Pearson correlations among metrics, as rows (x, y, r), in one pass."""
    pairs = [(x, y) for i, x in enumerate(metrics) for y in metrics[i:]]
    row = df.agg(*[pearson(F.col(x), F.col(y)).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def funnel(df: DataFrame, key: str, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows (key, stage, n): how many rows pass each condition and all before it."""
    met, made = F.lit(True), []
    for name, condition in stages:
        met = met & F.coalesce(condition, F.lit(False))
        made.append((name, F.count_if(met)))
    counts = df.groupBy(key).agg(*[c.alias(f"c{i}") for i, (_, c) in enumerate(made)])
    cells = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"c{i}").alias("n")) for i, (n, _) in enumerate(made)])
    return counts.select(key, F.explode(cells).alias("c")).select(key, "c.*")


def dyad_flag(flag: Column, *, expected: int = 2, strict: bool = False) -> Column:
    """Aggregate: poor if a sensor is, else caution, else both_clean if any has a flag, else incomplete.

    A failed sensor has no flag, so a failed and a clean one give both_clean; strict asks for the expected number.
    """
    flags = F.collect_set(flag)
    clean = F.count(flag) >= (expected if strict else 1)
    return F.when(F.array_contains(flags, "poor"), "poor").when(F.array_contains(flags, "caution"), "caution").when(clean, "both_clean").otherwise("incomplete")


def pretrial_quality() -> tuple[Column, Column]:
    """(flag, reasons) from the columns of segment_summary, n_rr included."""
    c = F.col
    short = c("duration").isNull() | (c("duration") < 60)
    rules = [
        ("poor", short, "less_than_60s_hr_available"),
        ("caution", ~short & ((c("duration") < 100) | (c("coverage_percent") < 80)), "short_or_incomplete_pretrial_hr_coverage"),
        ("poor", c("n_rr") < 30, "too_few_rr_intervals"),
        ("poor", c("plausible_percent") < 90, "rr_plausible_percent_below_90"),
        ("caution", c("plausible_percent").between(90, 95) & (c("plausible_percent") < 95), "rr_plausible_percent_90_to_95"),
        ("poor", c("extreme_percent") > 5, "extreme_hr_percent_above_5"),
        ("caution", (c("extreme_percent") > 0.5) & (c("extreme_percent") <= 5), "some_extreme_hr_values"),
        ("poor", c("min_hr") < 30, "minimum_hr_below_30"),
        ("caution", (c("min_hr") >= 30) & (c("min_hr") < 40), "minimum_hr_below_40"),
        ("poor", c("max_hr") > 220, "maximum_hr_above_220"),
        ("caution", (c("max_hr") > 200) & (c("max_hr") <= 220), "maximum_hr_above_200"),
        ("poor", c("sd_hr") > 30, "hr_sd_above_30"),
        ("caution", (c("sd_hr") > 20) & (c("sd_hr") <= 30), "hr_sd_20_to_30"),
        ("poor", c("range_hr") > 150, "hr_range_above_150"),
        ("caution", (c("range_hr") > 100) & (c("range_hr") <= 150), "hr_range_100_to_150"),
    ]
    return _verdict(rules, "; ", "objective_metrics_within_thresholds")


def _verdict(rules: list[tuple[str, Column, str]], sep: str, clean: str) -> tuple[Column, Column]:
    hit = {level: F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)) for k, c, _ in rules if k == level]), F.lit(False)) for level in ("poor", "caution")}
    flag = F.when(hit["poor"], "poor").when(hit["caution"], "caution").otherwise("clean")
    why = reasons(*[(c, name) for _, c, name in rules], sep=sep)
    return flag, F.when(flag == "clean", clean).otherwise(why)


def trial_quality(df: DataFrame, keys: list[str], a: str = "a", b: str = "b", least: int = 10) -> DataFrame:
    """flag and reasons of each trial from both members' heart rates."""
    made = [F.count("*").alias("n")]
    for role, x in (("A", a), ("B", b)):
        v = F.col(x)
        made += [
            (F.count(v) / F.count("*")).alias(f"cov_{role}"),
            F.min(v).alias(f"min_{role}"),
            F.max(v).alias(f"max_{role}"),
            share((v < 40) | (v > 200)).alias(f"ext_{role}"),
            share((v < 30) | (v > 220)).alias(f"sev_{role}"),
        ]
    s = df.groupBy(*keys).agg(*made)
    rules = []
    for role in "AB":
        cov, low, high, ext, sev = (F.col(f"{k}_{role}") for k in ("cov", "min", "max", "ext", "sev"))
        name = f"HR_{role}_"
        rules += [
            ("poor", cov < 0.80, name + "coverage_below_0.80"),
            ("caution", (cov >= 0.80) & (cov < 0.95), name + "coverage_below_0.95"),
            ("poor", low < 30, name + "min_below_30"),
            ("caution", (low >= 30) & (low < 40), name + "min_below_40"),
            ("poor", high > 220, name + "max_above_220"),
            ("caution", (high > 200) & (high <= 220), name + "max_above_200"),
            ("poor", sev > 0, name + "severe_extreme_values_present"),
            ("poor", (sev == 0) & (ext > 0.05), name + "extreme_fraction_above_0.05"),
            ("caution", (sev == 0) & (ext > 0.005) & (ext <= 0.05), name + "extreme_fraction_above_0.005"),
            ("poor", low.isNull(), name + "all_missing"),
        ]
    flag, why = _verdict(rules, ";", "trial_segment_metrics_within_thresholds")
    few = F.col("n") < least
    return s.select(*keys, "n", F.when(few, "poor").otherwise(flag).alias("flag"), F.when(few, F.concat(F.lit("too_few_samples_n_"), F.col("n"))).otherwise(why).alias("reasons"))


def odd_even(df: DataFrame, keys: list[str], x: str, order: str, least: int = 10) -> DataFrame:
    """Reliability of a series of intervals: Pearson of the first with the second of each pair in turn.

    n_pairs, r, status and label; an odd last interval has no pair.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    pairs = df.where(F.col(x).isNotNull()).withColumn("__n", n).groupBy(*keys, F.floor(F.col("__n") / 2).alias("__pair"))
    pairs = pairs.agg(F.max(F.when(F.col("__n") % 2 == 0, F.col(x))).alias("odd"), F.max(F.when(F.col("__n") % 2 == 1, F.col(x))).alias("even"))
    out = pairs.groupBy(*keys).agg(F.count("even").alias("n_pairs"), pearson(F.col("odd"), F.col("even"), 2).alias("r"))
    r = F.when(F.col("n_pairs") >= least, F.col("r"))
    status = F.when(F.col("n_pairs") < least, "too_few_pairs").when(F.col("r").isNull(), "undefined_correlation").otherwise("success")
    return out.select(*keys, "n_pairs", r.alias("r"), status.alias("status"), reliability_label(r).alias("label"))


def dyad_reliability(r_a: Column, r_b: Column) -> dict[str, Column]:
    """Least and mean reliability of two members, and the worse label."""
    labels = F.array(reliability_label(r_a), reliability_label(r_b))
    worst = F.coalesce(*[F.when(F.array_contains(labels, k), k) for k in ("low", "unavailable", "caution", "reliable")])
    n = F.nullif(r_a.isNotNull().cast("int") + r_b.isNotNull().cast("int"), F.lit(0))
    return {"r_min": F.least(r_a, r_b), "r_mean": (F.coalesce(r_a, F.lit(0.0)) + F.coalesce(r_b, F.lit(0.0))) / n, "label": worst}


def split_halves(df: DataFrame, keys: list[str], x: str, *order: Column) -> DataFrame:
    """Means of the odd and even samples by key, in the given order; both halves need two samples."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("__odd", n % 2 == 1).groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        F.count_if("__odd").alias("n_odd"),
        F.count_if(~F.col("__odd")).alias("n_even"),
        F.avg(F.when(F.col("__odd"), F.col(x))).alias("odd_half_mean"),
        F.avg(F.when(~F.col("__odd"), F.col(x))).alias("even_half_mean"),
    )
    return out.where("n_odd >= 2 and n_even >= 2")
