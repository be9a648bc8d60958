"""Gap groups and window summaries of samples that keep coming, on Structured Streaming.

The batch operators describe closed files; these do the same for a stream, with watermarks that bound the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_gap_groups(samples: DataFrame, keys: list[str], ts: str, gap: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """A row for each session of a key, once no sample within the gap can come any more: start, last, n.

    A session window closes a gap after its last sample, so samples exactly one gap apart are two sessions here.
    """
    sessions = samples.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return sessions.agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("w")


def live_window_summary(samples: DataFrame, keys: list[str], ts: str, x: str, width: str = "30 seconds", step: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """n, mean, SD and extremes of x in sliding windows of a key; windows include their start, not their end."""
    windows = samples.withWatermark(ts, late).groupBy(*keys, F.window(ts, width, step).alias("w"))
    out = windows.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "mean", "sd", "low", "high")
