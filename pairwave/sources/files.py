"""Scans of recordings, tables and metadata, manifests over them, and sinks. Every scan is a lazy DataFrame.

Sensor files have a free-text title in line 1 and the header in line 2; many files are read by one path pattern, each row
with its file, so a session's or a study's recordings are one distributed scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators.storage import cut
from . import sensor


def sensor_csv(spark: SparkSession, paths: str | list[str], time: str = "Timestamp", value: str = "Sample") -> DataFrame:
    """file, place, and the columns time and value of sensor CSVs, found by name in each file; rows without both numbers are dropped.

    Rows in order of place are in file order. See sensor.SensorCsv.
    """
    return sensor.read(spark, paths, time=time, value=value).withColumnsRenamed({"t": time, "x": value})


def titles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, title: the line above each file's header, if there is one; only the first bytes of a file are read."""
    return sensor.read(spark, paths, rows="titles").where("title is not null").select("file", "title")


def table_csv(spark: SparkSession, path: str, ids: list[str], numbers: list[str], required: list[str], drop_null: list[str] | None = None) -> DataFrame:
    """A CSV with a header: names trimmed, the first of equal names, ids as normalised text, numbers coerced, the rest text."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=False)
    seen: dict[str, str] = {}
    for c in raw.columns:
        seen.setdefault(c.strip(), c)
    if lacking := [c for c in required if c not in seen]:
        raise ValueError(f"{path} lacks the columns {lacking}")
    kind = lambda name, c: text.identifier(c) if name in ids else text.number(c) if name in numbers else c
    out = raw.select(*[kind(name, raw[f"`{c}`"]).alias(name) for name, c in seen.items()])
    return out.na.drop(subset=drop_null) if drop_null else out


def optional(read, empty: T.StructType, spark: SparkSession) -> DataFrame:
    """read(), or an empty table where its path doesn't exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], empty)


def resolve(df: DataFrame, names: list[str], *, within: bool = False) -> str | None:
    """The column that a list of names means: exactly, else in any case, else (within) as part of a column's name."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    for n in names:
        if n in df.columns:
            return n
    for n in names:
        if n.lower() in lower:
            return lower[n.lower()]
    return next((c for n in names if within for c in df.columns if n.lower() in c.lower()), None)


def intervals_of(df: DataFrame, *, rr: list[str], hr: list[str], t: list[str]) -> DataFrame:
    """df with rr_ms, hr_bpm and t from the first column of each list that it has; what is absent is derived.

    A rate is 60000 / interval and the other way round; without times the row's number in reading order is taken.
    """
    have = {k: resolve(df, names, within=True) for k, names in (("rr", rr), ("hr", hr), ("t", t))}
    if have["rr"] is None and have["hr"] is None:
        raise ValueError(f"no column of intervals or rates among {df.columns}")
    col = {k: text.number(df[f"`{c}`"].cast("string")) for k, c in have.items() if c}
    turned = lambda c: 60000 / F.nullif(c, F.lit(0.0))
    out = df.select("*", (col["rr"] if "rr" in col else turned(col["hr"])).alias("rr_ms"), (col["hr"] if "hr" in col else turned(col["rr"])).alias("hr_bpm"))
    return out.withColumn("t", col["t"] if "t" in col else F.monotonically_increasing_id().cast("double"))


def best_file(units: DataFrame, files: DataFrame, unit: str, file: str = "file", within: str = "recording_folder") -> DataFrame:
    """Each unit with the file of its folder that fits it best: unit, file, score (files without any fit don't count).

    units: unit, recording_folder, dyad_id, sensor_id, participant; files: recording_folder and the path. They meet by an
    equi-join on the folder, the first path of equal scores.
    """
    met = units.join(files.select(F.col(within), F.col(file).alias("__file")), within)
    score = file_score(F.col("__file"), F.col(within), F.col("dyad_id"), F.col("sensor_id"), F.col("participant"))
    met = met.withColumn("__score", score).where("__score > 0")
    best = met.groupBy(unit).agg(F.min(F.struct((-F.col("__score")).alias("s"), F.col("__file").alias("f"))).alias("x"))
    return best.select(unit, F.col("x.f").alias("file"), (-F.col("x.s")).alias("score"))


def validated(units: DataFrame, required: list[str], start: str, end: str, sensors: list[str], condition: str = "condition", sequences: dict[str, list[int]] | None = None) -> DataFrame:
    """units, if nothing is wrong with them; else a ValueError that counts every fault, found in one pass.

    Faults: lacking columns, no rows, unknown conditions, starts or ends that are no numbers, ends not after starts, blank
    sensors, and recording folders whose ids (timestamp_id by candidate_window) aren't the given sequence.
    """
    if lacking := [c for c in required if c not in units.columns]:
        raise ValueError(f"columns are missing: {lacking}")
    number = lambda c: F.col(c).cast("string").try_cast("double")
    checks = {
        "rows of an unknown condition": F.lower(F.coalesce(F.col(condition).cast("string"), F.lit(""))) == "unknown",
        f"rows without a number in {start}": number(start).isNull(),
        f"rows without a number in {end}": number(end).isNull(),
        f"rows with {end} not after {start}": F.coalesce(number(end) <= number(start), F.lit(False)),
        "rows with a blank sensor": F.coalesce(F.greatest(*[text.identifier(F.col(s)) == "" for s in sensors]), F.lit(True)),
    }
    found = units.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())]).first()
    faults = [f"{found[f'c{i}']} {name}" for i, name in enumerate(checks) if found[f"c{i}"]]
    if not found["n"]:
        faults.append("no rows")
    if sequences and "timestamp_id" in units.columns:
        mine = units.where(F.col("recording_folder").isin(*sequences))
        each = F.struct("candidate_window", F.col("timestamp_id").cast("string").try_cast("double").cast("long").alias("id"))
        ids = mine.groupBy("recording_folder").agg(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["id"]).alias("ids"))
        # a row for each named folder
        faults += [f"ids {r['ids']} in {r['recording_folder']}" for r in ids.collect() if [x for x in r["ids"] if x is not None] != sequences[r["recording_folder"]]]
    if faults:
        raise ValueError("; ".join(faults))
    return units


def pending(inputs: DataFrame, manifest: DataFrame | None, key: str = "file", *, again: bool = True) -> DataFrame:
    """The inputs that a manifest (key, status) doesn't name as done; again: those that failed are due once more."""
    if manifest is None:
        return inputs
    done = manifest.where("status = 'success'") if again else manifest
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def append_manifest(results: DataFrame, folder: str, run: str, key: str = "file") -> None:
    """Adds the rows (key, status, n_rows, error) of a run to a manifest, a folder a run; a run that is done again replaces its own."""
    results.select(key, "status", "n_rows", "error").write.mode("overwrite").parquet(f"{folder}/run={run}")


def write_new_segments(df: DataFrame, folder: str, by: list[str]) -> DataFrame:
    """Writes the segments (keys by) that folder lacks as CSV; the status of each: saved or skipped_existing_file.

    Which exist is read off the folder's partitions, by a scan of names. Null and empty keys are one, as they are in names.
    For segments that must stand once though runs die or meet, see runs.RunLog.
    """
    spark = df.sparkSession
    name = F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]).alias("__key")
    rows = df.withColumn("__key", name)
    keys = rows.select("__key").distinct()
    each = [F.col("__key")[c].alias(c) for c in by]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in by])
    try:
        old = cut(spark.read.schema(schema).option("basePath", folder).csv(folder).select(name).distinct())
        status = keys.join(old.withColumn("__old", F.lit(True)), "__key", "left")
        status = status.select(*each, F.when(F.col("__old"), "skipped_existing_file").otherwise("saved").alias("status"))
        fresh = rows.join(old, "__key", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        status, fresh = keys.select(*each, F.lit("saved").alias("status")), rows
    status = cut(status)
    fresh.drop("__key").repartition(*by).write.mode("append").partitionBy(*by).option("header", True).csv(folder)
    return status


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """session, sensor, kind, file, bytes of a study's folders: root/yyyy_MM_dd-HH_mm_ss/digits/name.csv; the first file of each kind."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root).select("path", "length")
    parts = found.select(F.split("path", "/").alias("p"), "path", F.col("length").alias("bytes"))
    at = lambda k: F.element_at("p", -k)
    named = parts.select(at(3).alias("session"), at(2).alias("sensor"), F.regexp_extract(at(1), "(ECG|Acc|EulerAngles)", 1).alias("kind"), F.col("path").alias("file"), "bytes", at(1).alias("name"))
    named = named.where(F.col("session").rlike(r"^\d{4}_\d\d_\d\d-\d\d_\d\d_\d\d$") & F.col("sensor").rlike(r"^\d+$") & (F.col("kind") != "") & ~F.col("name").startswith("._"))
    return named.groupBy("session", "sensor", "kind").agg(F.min("file").alias("file"), F.min_by("bytes", "file").alias("bytes"))


def sensor_manifest(units: DataFrame) -> DataFrame:
    """A row for each (recording_folder, sensor_id) of units with sensor_A and sensor_B, the first role of equals."""
    both = units.select("recording_folder", F.expr("stack(2, 'A', sensor_A, 'B', sensor_B) AS (role, sensor_id)")).where("trim(sensor_id) <> ''")
    return both.groupBy("recording_folder", "sensor_id").agg(F.min("role").alias("role"))


def paired_manifest(files: DataFrame, summary: DataFrame) -> DataFrame:
    """Files (column file) with the summary row of the same base name (column paired_file)."""
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    return files.withColumn("__base", base("file")).join(summary.withColumn("__base", base("paired_file")), "__base", "left").drop("__base")


def long_form(pairs: DataFrame, value_a: str = "HR_A_BPM", value_b: str = "HR_B_BPM") -> DataFrame:
    """A row for each member's sample: participant (the sensor where there is none), situation, t, x > 0."""
    situation = F.concat_ws("__", "recording_folder", F.col("candidate_window").cast("string"), F.col("trial").cast("string"))
    who = lambda r: F.coalesce(F.nullif(F.trim(F.col(f"participant_{r}").cast("string")), F.lit("")), F.col(f"sensor_{r}").cast("string"))
    each = F.array(*[F.struct(who(r).alias("participant"), F.col(v).cast("double").alias("x")) for r, v in (("A", value_a), ("B", value_b))])
    out = pairs.select(situation.alias("situation"), F.col("TimeUnix").alias("t"), F.explode(each).alias("s")).select("s.participant", "situation", "t", "s.x")
    return out.where("t is not null and not isnan(t) and x > 0 and not isnan(x)")


def metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """participant_1, participant_2, sampling_rate_p1, sampling_rate_p2 of whole-file JSON."""
    return spark.read.schema("participant_1 string, participant_2 string, sampling_rate_p1 double, sampling_rate_p2 double").json(path, multiLine=True)


def file_score(path: Column, folder: Column, dyad: Column, sensor: Column, participant: Column) -> Column:
    """How well a file's path fits a unit's folder (5), dyad (2), sensor (5) and participant (3)."""
    has = lambda c, n: F.when((c != "") & path.contains(c), n).otherwise(0)
    return has(folder, 5) + has(dyad, 2) + has(sensor, 5) + has(participant, 3)


def write_csv(df: DataFrame, folder: str, by: list[str] | None = None, *, overwrite: bool = False) -> None:
    """CSV with a header; by: a folder for each key. An existing folder is kept unless overwrite is set."""
    out = df.repartition(*by) if by else df
    writer = out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(folder)


def run_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """item, value, n: the counts of every value of the columns, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return df.select(each).groupBy("x.item", "x.value").agg(F.count("*").alias("n"))
