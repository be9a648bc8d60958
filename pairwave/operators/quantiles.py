"""Exact quantiles of groups of any size, by histograms that are refined around the ranks that are asked for.

An exact percentile in one aggregate holds all distinct values of a group in one task. Here each asked rank has an interval of
values that holds it, at first the group's least to its largest. A round counts the interval's values in BUCKETS equal parts
(combined before the shuffle), finds the part in which the rank lies, and goes on within that part's own least and largest
value; it ends when these are one. From the second round on only the values within intervals are read. A round makes an
interval a BUCKETS-th at least, so doubles are told apart after a few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

BUCKETS = 4096
#: Ranks that are broadcast at most.
MOST_RANKS = 100_000


def quantiles(df: DataFrame, keys: list[str], metrics: list[str], shares: list[float], buckets: int = BUCKETS) -> DataFrame:
    """keys, metric, share, value: linear interpolation between the ranks around (n - 1) * share of the values that aren't null."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    rows = df.select(F.struct(*keys).alias("__key"), F.explode(each).alias("x")).select("__key", "x.metric", "x.v").where("v is not null")
    sizes = rows.groupBy("__key", "metric").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    asked = F.array(*[F.struct(F.lit(float(p)).alias("share"), place(p).alias("place")) for p in shares])
    asked = cut(sizes.select("*", F.explode(asked).alias("a")).select("__key", "metric", "n", "lo", "hi", "a.share", "a.place"))
    ranks = asked.select("__key", "metric", "lo", "hi", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    ranks = cut(ranks.withColumn("below", F.lit(0).cast("long")))
    done = ranks.where("lo = hi")
    left = ranks.where("lo < hi")
    on = ["__key", "metric"]
    while many := left.count():
        met = rows.join(F.broadcast(left) if many <= MOST_RANKS else left, on).where("v between lo and hi")
        bucket = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        counts = met.groupBy("__key", "metric", "rank", "below", bucket.alias("bucket")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = Window.partitionBy("__key", "metric", "rank").orderBy("bucket")  # at most buckets rows
        counts = counts.withColumn("upto", F.col("below") + F.sum("c").over(w))
        found = counts.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        found = cut(found.select("__key", "metric", "lo", "hi", "rank", (F.col("upto") - F.col("c")).alias("below")))
        done, left = done.unionByName(found.where("lo = hi")), found.where("lo < hi")
        if not left.isEmpty():
            now = left.select("__key", "metric", "rank", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
            rows = met.join(F.broadcast(now) if many <= MOST_RANKS else now, ["__key", "metric", "rank"]).where("v between __lo and __hi")
            rows, on = cut(rows.select("__key", "metric", "rank", "v")), ["__key", "metric", "rank"]
    at = lambda name, side: done.select("__key", "metric", F.col("rank").alias(side), F.col("lo").alias(name))
    out = asked.withColumn("low", F.floor("place")).withColumn("high", F.ceil("place"))
    out = out.join(at("x", "low"), ["__key", "metric", "low"]).join(at("y", "high"), ["__key", "metric", "high"])
    off = F.col("place") - F.col("low")
    value = F.when(off == 0, F.col("x")).otherwise((1 - off) * F.col("x") + off * F.col("y"))
    return out.select(*[F.col("__key")[k].alias(k) for k in keys], "metric", "share", value.alias("value"))
