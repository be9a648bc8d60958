"""The table of analysis units, from a sheet with two rows a session to conditions, reasons and behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..operators import units
from .standin import SAMPLES, samples


def sheet(spark, sf):
    """sensor, n and a sheet's columns: every sensor's readings as the rows of its sheet."""
    s = samples(spark, sf)
    e = F.col("event_id")
    return s.select(
        "sensor",
        "n",
        F.when(e % 11 == 0, "pilot").otherwise(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd")).alias("date"),
        F.date_format(F.timestamp_seconds("t"), "HH:mm:ss").alias("time"),
        F.when(e % 13 != 0, F.concat_ws(" , ", F.col("sensor") % 40 + e % 2, e % 7)).alias("participant"),
        F.when(e % 3 == 0, " a").when(e % 3 == 1, "B").alias("role"),
        F.when(e % 5 == 0, " ").when(e % 5 < 3, "ff-fe-ee").when(e % 5 == 3, "fe - ff").alias("trial_order"),
        F.when(e % 6 == 0, "Ball fell twice").when(e % 6 == 1, "they talked, then stopped").when(e % 6 == 2, "finish line; sensor 3").when(e % 6 == 3, " ").alias("comments"),
        F.when(e % 4 > 0, F.col("event_type")).alias("ra"),
    )


def _behaviour(spark, sf):
    """Means of roots by pair and trial: means of hundredths would lie half-way between rounded values."""
    s = samples(spark, sf).withColumn("root", F.sqrt(F.abs("x")))
    pair, trial = (F.floor(F.col("sensor") % 40 / 2)).alias("pair1"), (F.col("n") % 7).alias("trial")
    mean = F.avg(F.when(F.col("event_id") % 2 == 0, F.col("sensor") % 40 + F.col("n") % 3)).alias("Participant_ID_mean")
    return s.where("event_type <> 'click'").groupBy(pair, trial).agg(F.avg(F.when(F.col("x") > 20, F.col("root"))).alias("table_motion_mean"), F.avg("root").alias("trial_duration_mean"), mean)


def sheet_sessions(spark, sf):
    """Sessions of two rows each, folded off every sensor's sheet, with their pairs."""
    out = units.with_pair(units.sessions(sheet(spark, sf), ["sensor"], "n"), ["sensor", "block"], _behaviour(spark, sf))
    return out.withColumn("block", F.col("block").cast("long")).withColumn("participant_mean", rounded("participant_mean"))


def joined_units(spark, sf):
    """Windows, a reading each, with their session, condition, reasons and behaviour."""
    s = samples(spark, sf)
    folder = lambda block: F.concat_ws("_", "sensor", block)
    w = s.select(
        folder(F.col("n") - F.col("n") % 4 + 1).alias("recording_folder"),
        F.col("event_id").alias("candidate_window"),
        (F.col("n") % 7).alias("trial"),
        (F.col("n") % 7 == 0).alias("is_practice"),
        (F.col("x") > 20).alias("usable_for_dyadic_ecg"),
        F.col("x").alias("window_duration_sec"),
    )
    behaviour = _behaviour(spark, sf)
    made = units.with_pair(units.sessions(sheet(spark, sf), ["sensor"], "n"), ["sensor", "block"], behaviour)
    made = made.withColumn("recording_folder", folder("block")).drop("sensor", "block")
    out = units.analysis_units(w, made, behaviour, comments_exclude=True)
    own = ["recording_folder", "candidate_window", "trial", "dyad_id", "pair1", "participant_A", "participant_B", "condition", "is_pilot"]
    return out.select(*own, "exclude_from_main_analysis", "exclude_reason", "folder_metadata_match_note", "aggregated_data_missing", rounded("table_motion_mean").alias("table_motion_mean"), rounded("duration_difference_sec").alias("duration_difference_sec"))


NAMES = (sheet_sessions, joined_units)
QUERIES = {f.__name__: f for f in NAMES}

_SHEET = f"""{SAMPLES}, sheet AS (SELECT sensor, n, t, event_id AS e, event_type, x,
    CASE WHEN event_id % 11 = 0 THEN 'pilot' ELSE strftime(make_timestamp((t * 1000000)::BIGINT), '%Y-%m-%d') END AS date,
    strftime(make_timestamp((t * 1000000)::BIGINT), '%H:%M') AS time,
    CASE WHEN event_id % 13 <> 0 THEN sensor % 40 + event_id % 2 END AS participant, CASE WHEN event_id % 13 <> 0 THEN (event_id % 7)::VARCHAR ELSE '' END AS suffix,
    CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS role,
    CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ff-fe-ee' WHEN 2 THEN 'ff-fe-ee' WHEN 3 THEN 'fe - ff' END AS trial_order,
    CASE event_id % 6 WHEN 0 THEN 'Ball fell twice' WHEN 1 THEN 'they talked, then stopped' WHEN 2 THEN 'finish line; sensor 3' END AS comments,
    CASE WHEN event_id % 4 > 0 THEN event_type END AS ra FROM samples),
  near AS (SELECT *, coalesce(max(CASE WHEN trial_order IS NULL THEN n END) OVER (PARTITION BY sensor ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blank FROM sheet),
  one AS (SELECT * FROM near WHERE trial_order IS NOT NULL AND (n - blank) % 2 = 1),
  behaviour AS (SELECT sensor % 40 // 2 AS pair1, n % 7 AS trial, avg(CASE WHEN x > 20 THEN sqrt(abs(x)) END) AS table_motion_mean, avg(sqrt(abs(x))) AS trial_duration_mean,
    avg(CASE WHEN event_id % 2 = 0 THEN sensor % 40 + n % 3 END) AS pm FROM samples WHERE event_type <> 'click' GROUP BY ALL),
  medians AS (SELECT pair1, median(pm) AS m FROM behaviour WHERE trial > 0 GROUP BY pair1),
  blocks AS (SELECT a.sensor, a.n AS block, a.date AS session_date_raw, a.time AS session_time, a.participant AS p1, b.participant AS p2, a.suffix AS s1, b.suffix AS s2, a.role AS r1, b.role AS r2,
    a.trial_order, a.date = 'pilot' OR b.date = 'pilot' AS is_pilot, concat_ws(' | ', a.comments, b.comments) AS c, coalesce(a.ra, b.ra) AS ra,
    (coalesce(a.participant, b.participant) + coalesce(b.participant, a.participant)) / 2 AS participant_mean FROM one a JOIN sheet b ON b.sensor = a.sensor AND b.n = a.n + 1),
  made AS (SELECT *, CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN format('P{{:02d}}_P{{:02d}}', p1, p2) ELSE '' END AS dyad_id,
    (SELECT min_by(pair1, (abs(m - participant_mean), pair1)) FROM medians WHERE abs(m - participant_mean) <= 0.6) AS pair1,
    CASE WHEN r1 = 'A' THEN p1 WHEN r2 = 'A' THEN p2 END AS participant_A, CASE WHEN r1 = 'B' THEN p1 WHEN r2 = 'B' THEN p2 END AS participant_B,
    CASE WHEN r1 = 'A' THEN s1 WHEN r2 = 'A' THEN s2 ELSE '' END AS sensor_A_suffix, CASE WHEN r1 = 'B' THEN s1 WHEN r2 = 'B' THEN s2 ELSE '' END AS sensor_B_suffix FROM blocks)"""

ORACLES = {
    "sheet_sessions": f"""WITH {_SHEET} SELECT sensor, block, replace(session_date_raw, '-', '/') AS session_date, session_time, dyad_id, p1 AS participant_1, p2 AS participant_2, round(participant_mean, 6) AS participant_mean, pair1,
        least(s1, s2) || ';' || greatest(s1, s2) AS sensor_suffix_set, participant_A, participant_B, sensor_A_suffix, sensor_B_suffix, false AS "participant_A_is_confederate", false AS "participant_B_is_confederate",
        trial_order, is_pilot, c AS session_comments, ra, c LIKE '%Ball fell%' AS ball_drop_flag, c LIKE '%stopped%' AS stopped_flag, c LIKE '%talked%' AS talking_laughing_flag, c LIKE '%finish line%' AS wrong_way_flag, c LIKE '%sensor%' AS sensor_issue_comment_flag FROM made""",
    "joined_units": f"""WITH {_SHEET}, u AS (SELECT w.sensor || '_' || (w.n - w.n % 4 + 1) AS recording_folder, w.event_id AS candidate_window, w.n % 7 AS trial, w.x, m.*, m.block IS NULL AS lone,
          CASE m.trial_order WHEN 'ff-fe-ee' THEN ['FF', 'FF', 'FE', 'FE', 'EE', 'EE'] WHEN 'fe - ff' THEN ['FE', 'FE', 'FF', 'FF'] END AS o
          FROM samples w LEFT JOIN made m ON m.sensor = w.sensor AND m.block = w.n - w.n % 4 + 1),
        v AS (SELECT *, CASE WHEN trial = 0 THEN 'practice' ELSE coalesce(o[trial], 'unknown') END AS condition FROM u),
        r AS (SELECT *, concat_ws('; ', CASE WHEN trial = 0 THEN 'practice' END, CASE WHEN x > 20 THEN NULL ELSE 'not_usable_for_dyadic_ecg' END, CASE WHEN is_pilot THEN 'pilot' END,
          CASE WHEN condition = 'unknown' THEN 'condition_unknown' END, CASE WHEN c LIKE '%Ball fell%' OR c LIKE '%stopped%' OR c LIKE '%finish line%' THEN 'comment_flag_excluded' END) AS why FROM v)
        SELECT recording_folder, candidate_window, r.trial, coalesce(dyad_id, '') AS dyad_id, r.pair1, participant_A, participant_B, condition, coalesce(is_pilot, false) AS is_pilot, why <> '' AS exclude_from_main_analysis,
          why AS exclude_reason, CASE WHEN lone THEN 'No metadata match found.' ELSE '' END AS folder_metadata_match_note, table_motion_mean IS NULL AS aggregated_data_missing,
          round(table_motion_mean, 6) AS table_motion_mean, round(x - trial_duration_mean, 6) AS duration_difference_sec FROM r LEFT JOIN behaviour b ON b.pair1 = r.pair1 AND b.trial = r.trial""",
}
