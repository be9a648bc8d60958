"""The driver's tables in the roles of recordings, dyads and trials.

events: a user is a sensor, value its heart rate, ts the sample time; users 2d and 2d+1 form dyad d; the common grid is
hourly; a trial is a block of two days of the grid or of 30 samples.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, series

HOUR = 3600.0
HOURS_PER_TRIAL = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str):
    """A timestamp without zone as Unix seconds, UTC."""
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, event_id, event_type, t, x."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sensor"), "event_id", "event_type", seconds("ts").alias("t"), F.col("value").alias("x"))


def samples(spark: SparkSession, sf_dir: str, span: float = series.SPAN) -> DataFrame:
    """readings with n (place in the sensor's series from 1)."""
    return series.numbered(readings(spark, sf_dir), ["sensor"], "t", "event_id", span=span)


def dyads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dyad, k, t, a, b, trial on the hourly grid."""
    grid = series.to_grid(readings(spark, sf_dir), ["sensor"], HOUR, tie="event_id")
    return series.paired(grid, "sensor").withColumn("trial", F.floor(F.col("k") / HOURS_PER_TRIAL))


def blocks_of(spark: SparkSession, sf_dir: str, hours: int = HOURS_PER_TRIAL, name: str = "trial"):
    """The dyads' blocks of hours for a kernel, without a row a grid point: see blocks.by_block."""
    made = series.stretches(readings(spark, sf_dir), ["sensor"], HOUR, tie="event_id")
    return functools.partial(blocks.by_block, made, "sensor", HOUR, hours, block=name)


# ---- the same in DuckDB SQL, as common table expressions

SAMPLES = """samples AS (
  SELECT user_id AS sensor, event_id, event_type, epoch_us(ts) / 1e6 AS t, value AS x,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""

GRID = f"""{SAMPLES}, stretches AS (
  SELECT sensor, t AS t0, x AS x0, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM samples
  WINDOW w AS (PARTITION BY sensor ORDER BY t)), grid AS (
  SELECT sensor, k, k * 3600.0::DOUBLE AS t, x0 + (k * 3600.0::DOUBLE - t0) * (x1 - x0) / (t1 - t0) AS x FROM (
    SELECT *, unnest(generate_series(ceil(t0 / 3600)::BIGINT, floor(t1 / 3600)::BIGINT)) AS k FROM stretches WHERE t1 IS NOT NULL))"""

DYADS = f"""{GRID}, dyads AS (
  SELECT a.sensor // 2 AS dyad, a.k, a.t, a.x AS a, b.x AS b, a.k // 48 AS trial
  FROM grid a JOIN grid b ON b.sensor = a.sensor + 1 AND b.k = a.k WHERE a.sensor % 2 = 0)"""


def r_sql(x: str, y: str, least: int = 3) -> str:
    """Pearson's r of two columns without nulls."""
    return f"CASE WHEN count(*) >= {least} THEN covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0) END"
