"""Helpers that several operators share: shared folders, checkpoints, an ordered index, graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names that folder in spark.checkpoint.dir. Only on one machine (a local master, as in tests) may the
    setting be absent; a folder of our own is used then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark, "_pairwave_shared", None)
        if root is None:
            root = spark._pairwave_shared = "file://" + tempfile.mkdtemp(prefix="pairwave-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parts_for(df: DataFrame, rows: int, each: int = 50_000) -> int:
    """How many partitions so many narrow rows need, at most as many as a shuffle has: a small step leaves few files."""
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(8, -(-rows // each)))


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to reliable storage, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """checkpoint(df) for loops: the result's plan also forgets what was known of the values, which else grows each round.

    parts: partitions of the result, where it is small.
    """
    spark, done = df.sparkSession, checkpoint(df if parts is None else df.coalesce(parts))
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def pinned(df: DataFrame) -> DataFrame:
    """df cut into partitions once, for rows that are numbered by partition and read more than once.

    A scan planned anew may cut the files otherwise (the size of a split depends on the cores registered then) and number
    the rows otherwise; every use of the returned frame reads the same file ranges by the same partition numbers, also
    when a task is run again. Nothing is read or written here.
    """
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    rows.partitions()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def _only_cut(docs: DataFrame) -> bool:
    """Whether docs is columns and rows of one scan, so that a place in a file is in one row at most."""
    plan, names = docs._jdf.queryExecution().analyzed(), set()
    while True:
        names.add(plan.nodeName())
        below = plan.children()
        if below.size() != 1:
            return below.size() == 0 and names <= {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"} | {n for n in names if n.startswith("Relation")}
        plan = below.apply(0)


def numbered(docs: DataFrame) -> DataFrame:
    """doc (a struct of all columns, so that none clashes), doc_id, text, and __row, a number alike at every use.

    Rows of Parquet files are named by the file and the row's place in it, however the files are cut; rows of anything
    else by partitions that are fixed here.
    """
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    try:
        rows = docs.select(whole, "_metadata.file_path", "_metadata.row_index") if _only_cut(docs) else None
    except AnalysisException:
        rows = None
    if rows is None:
        rows = pinned(docs.select(whole)).select("doc", F.lit("").alias("file_path"), F.monotonically_increasing_id().alias("row_index"))
    name = F.struct(F.xxhash64("file_path").alias("file"), F.col("row_index").alias("place"))
    return rows.select("doc", "doc.doc_id", "doc.text", name.alias("__row"))


def fresh(columns: list[str], name: str) -> str:
    """name, with as many underscores behind it as none of the columns has, whatever its capitals."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def with_order(df: DataFrame, *keys: str, name: str, parts: int | None = None) -> DataFrame:
    """df with a dense 0-based position in the order of the keys, materialised.

    One range shuffle; the only thing that passes through the driver is one count for each partition.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ordered = cut(ordered.select("*", F.spark_partition_id().alias("__part"), local.alias("__local")), parts)
    counts = ordered.groupBy("__part").agg((F.max("__local") + 1).alias("n")).orderBy("__part").collect()
    starts, total = [], 0
    for row in counts:
        starts.append((row["__part"], total))
        total += row["n"]
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    return (
        ordered.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__start") + F.col("__local"))
        .drop("__part", "__local", "__start")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (u, v): rows (node, root), root the smallest node; only nodes with an edge.

    Alternating large-star and small-star steps; every step is a minimum by key (combined before the shuffle) and a
    join. Minima are written before they are joined, so both sides of the join are plain shuffles of which adaptive
    execution splits the partition of a hub with many neighbours. The number of rounds is logarithmic in practice.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    # u is always the larger end
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut(now)
    seen = state(now)
    # edges never grow in number, so their partitions don't either
    parts = parts_for(now, seen[0])
    now = now.coalesce(parts)
    while seen[0]:
        sym = both(now)
        low = cut(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), parts)
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, parts)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), parts)
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = cut(small, parts)
        before, seen = seen, state(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
