"""A log of runs: which segments are written, by which run, with what status, times and counts.

A run writes its new segments and a status row for each as tables of random names, then enters one immutable line that names
them. The entry is written whole under a hidden name and takes the next free number by a rename that refuses a taken one. So
a run that dies at any step is no part of the log and may be sent again; a run that was entered is not done twice; and of two
runs at once the second finds its number taken, looks again at what is there, and writes only what still lacks. A segment
stands once, whatever stops. Keys may be null.

Tables: segments are read through the log only, so what a dead run left behind is never seen.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import cut, enter, listed

ENTRY = "run string, table string, started double, ended double, rows long, segments long, parameters string"


class RunLog:
    """A folder with data, status and log."""

    def __init__(self, spark: SparkSession, folder: str, by: list[str]):
        self.spark, self.folder, self.by = spark, folder.rstrip("/"), by

    def entries(self) -> DataFrame:
        """number, run, table, started, ended, rows, segments, parameters (JSON) of each entered run."""
        if not listed(self.spark, f"{self.folder}/log"):
            return self.spark.createDataFrame([], "number long, " + ENTRY)
        number = F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long").alias("number")
        return self.spark.read.schema(ENTRY).json(f"{self.folder}/log").select(number, "*")

    def _read(self, kind: str, tables: list[str]) -> DataFrame | None:
        if not tables:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.folder}/{kind}/{t}" for t in tables])

    def _tables(self) -> list[str]:
        return [r["table"] for r in self.entries().orderBy("number").select("table").collect()]  # a row a run

    def segments(self) -> DataFrame | None:
        """The rows of all entered segments; None before the first run."""
        return self._read("data", self._tables())

    def status(self) -> DataFrame:
        """run, the keys, status and n_rows of each segment of each run."""
        out = None
        for r in self.entries().orderBy("number").collect():
            one = self.spark.read.parquet(f"{self.folder}/status/{r['table']}").withColumn("run", F.lit(r["run"]))
            out = one if out is None else out.unionByName(one)
        if out is None:
            return self.spark.createDataFrame([], ", ".join(["run string", *(f"{k} string" for k in self.by), "status string", "n_rows long"]))
        return out.select("run", *self.by, "status", "n_rows")

    def write(self, run: str, rows: DataFrame, parameters: dict | None = None) -> bool:
        """Writes those segments of rows that the log lacks; False if the run was entered before.

        Statuses: saved, skipped_existing_file.
        """
        started = time.time()
        rows = rows.withColumn("__key", F.struct(*self.by))
        while True:
            known = self.entries().select("run", "table").collect()
            if any(r["run"] == run for r in known):
                return False
            there = self._read("data", [r["table"] for r in known])
            counts = rows.groupBy("__key").agg(F.count("*").alias("n_rows"))
            if there is None:
                fresh, counts = rows, counts.withColumn("status", F.lit("saved"))
            else:
                # one column that is never null, so that null keys meet
                old = cut(there.select(F.struct(*self.by).alias("__key")).distinct())
                fresh = rows.join(old, "__key", "left_anti")
                counts = counts.join(old.withColumn("__old", F.lit(True)), "__key", "left")
                counts = counts.withColumn("status", F.when(F.col("__old"), "skipped_existing_file").otherwise("saved"))
            table = uuid.uuid4().hex
            fresh.drop("__key").write.parquet(f"{self.folder}/data/{table}")
            counts.select(*[F.col("__key")[k].alias(k) for k in self.by], "status", "n_rows").write.parquet(f"{self.folder}/status/{table}")
            saved = self.spark.read.parquet(f"{self.folder}/status/{table}").where("status = 'saved'").agg(F.count("*").alias("s"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first()
            line = {"run": run, "table": table, "started": started, "ended": time.time(), "rows": saved["n"], "segments": saved["s"], "parameters": json.dumps(parameters or {}, sort_keys=True)}
            if enter(self.spark, f"{self.folder}/log", f"{len(known):012d}.json", json.dumps(line) + "\n"):
                return True

    def summary(self) -> DataFrame:
        """item, value, n: runs, segments, rows and seconds over all runs, and the segments of each status."""
        e = self.entries().agg(
            F.count("*").cast("double").alias("runs"), F.sum("segments").cast("double").alias("segments"),
            F.sum("rows").cast("double").alias("rows"), F.sum(F.col("ended") - F.col("started")).alias("elapsed_sec"),
        )
        scalars = e.unpivot([], e.columns, "item", "n").select("item", F.lit(None).cast("string").alias("value"), F.coalesce("n", F.lit(0.0)).alias("n"))
        return scalars.unionByName(self.status().groupBy(F.lit("status").alias("item"), F.col("status").alias("value")).agg(F.count("*").cast("double").alias("n")))

    def write_summary(self) -> None:
        """The summary and the entries as JSON lines beside the log, replaced each time."""
        self.summary().coalesce(1).write.mode("overwrite").json(f"{self.folder}/summary")
