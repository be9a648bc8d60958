"""Token counts as rollups that signed deltas maintain.

Totals by source, language and tokenizer version are sums, so an insert adds a document's counts, a delete subtracts them,
and a revised count subtracts the old and adds the new; documents are never counted again. A batch of deltas is summed
(combined before the shuffle) and written as a small table of a random name; then a log entry, named by the batch's ID,
commits it. An entry is written whole under a hidden name and takes its own name by a rename that refuses one that is there,
so a writer that dies at any step leaves either the whole entry or none, and its batch may be sent again. A batch that failed
or lost executors half-way, or whose ID another writer committed first, is no part of the totals; a committed table is never
changed. Totals join the tables with the log in Spark. compact() commits the totals of all tables in place of the tables
themselves in the same way. Its entry is named by the number of compactions before it, read ahead of the tables: of two at
once only one enters, whatever was committed between them; the log keeps the batch IDs.

Renames that refuse are atomic on HDFS. On a local disk or an object store two writers of one entry may both succeed; the
later entry then replaces the earlier one whole, so one batch or compaction counts, never both and never a part.

Versions: words-1 (white-space words), bytes-1 (UTF-8), both counted by built-in functions, and any vocabulary file of the
tokenizers library, whose IDs are counted in Arrow batches.

Defined cases: a null text has 0 tokens; null sources and languages are groups of their own; repeated rows count each;
totals of 0 documents and 0 tokens are left out; an empty table commits an empty batch; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, fresh
from .tokens import encoder, slices

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
BUILT_IN = {"words-1": lambda text: F.regexp_count(text, F.lit(WORD)), "bytes-1": F.octet_length}


def counted(docs: DataFrame, versions: dict[str, str | None], keep: tuple[str, ...] = ()) -> DataFrame:
    """source, lang, the columns in keep and counts (an array of tokenizer and tokens) of each row, in one pass over the texts.

    versions: the vocabulary file of each version, or None for one that is built in.
    """
    own = [n for n, path in versions.items() if path is None]
    others = {n: path for n, path in versions.items() if path is not None}
    taken = ["source", "lang", "counts", *keep]
    built_names, other_names = [fresh(taken, f"n{i}") for i in range(len(own))], [fresh(taken, f"v{i}") for i in range(len(others))]
    built = [F.coalesce(BUILT_IN[n](F.col("text")), F.lit(0)).cast("long").alias(c) for c, n in zip(built_names, own)]
    text = F.col("text").alias(fresh(taken, "text"))
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *keep, *built, text)
    names = [*rows.columns[:-1], *other_names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(path).encode for path in others.values()]
        for batch in batches:
            texts, sizes = batch.column(batch.num_columns - 1), [[] for _ in encoders]
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                part = texts.slice(a, b - a).to_pylist()
                for encode, counts in zip(encoders, sizes):
                    counts += map(len, encode(part))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in sizes)], names)

    if others:
        rows = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in other_names)]))
    pair = lambda name, column: F.struct(F.lit(name).alias("tokenizer"), F.col(column).alias("tokens"))
    counts = [pair(n, c) for n, c in zip(own, built_names)] + [pair(n, c) for n, c in zip(others, other_names)]
    return rows.select("source", "lang", *keep, F.array(*counts).alias("counts"))


def inserts(rows: DataFrame, *versions: str) -> DataFrame:
    """source, lang, tokenizer, docs, tokens of counted rows, for some versions."""
    each = rows.select("source", "lang", F.explode("counts").alias("x")).where(F.col("x.tokenizer").isin(*versions))
    return each.select("source", "lang", "x.tokenizer", F.lit(1).cast("long").alias("docs"), "x.tokens")


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(new)


class Rollup:
    """A folder of tables (data) and of the log entries that commit them (log)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _store(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _has(self, name: str) -> bool:
        store, path = self._store(name)
        return store.exists(path)

    def _write(self, sums: DataFrame) -> str:
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.folder}/data/table={name}")
        return name

    def _draft(self, lines: list[str]):
        """The path of a whole entry that has a hidden name yet."""
        store, path = self._store(f"log/.{uuid.uuid4().hex}")
        out = store.create(path, False)
        out.write(bytearray("".join(x + "\n" for x in lines).encode()))
        out.close()
        return path

    def _enter(self, entry: str, lines: list[str]) -> bool:
        """Names a log entry; False if there is one of that name."""
        fs, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        store, path = self._store(f"log/{entry}")
        draft = self._draft(lines)
        rename = getattr(fs, "Options$Rename")
        careful = gateway.new_array(rename, 1)
        careful[0] = rename.NONE
        try:
            fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, careful)
            return True
        except Exception:
            if not store.exists(path):
                raise
            store.delete(draft, False)
            return False

    def _live(self) -> DataFrame:
        """table: those entered with + and not with -."""
        log = self.spark.read.text(f"{self.folder}/log").where("length(value) = 33")
        signs = log.groupBy(F.substring("value", 2, 32).alias("table")).agg(F.min(F.substring("value", 1, 1)).alias("low"), F.max(F.substring("value", 1, 1)).alias("high"))
        return signs.where("low = '+' and high = '+'").select("table")

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch once; False if it was committed before."""
        entry = "batch-" + quote(batch_id, safe="")
        if self._has(f"log/{entry}"):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return self._enter(entry, ["+" + self._write(sums)])

    def _sums(self, tables: DataFrame) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA + ", table string").option("basePath", f"{self.folder}/data").parquet(f"{self.folder}/data")
        rows = rows.join(tables, "table", "left_semi")
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        return self._sums(self._live()) if self._has("log") else self.spark.createDataFrame([], SCHEMA)

    def compact(self) -> None:
        """One table counts instead of all committed since the last call, whose names (not their rows) pass the driver."""
        if not self._has("log"):
            return
        # before the tables: another compaction that is entered from here on makes this one's name taken
        entry = f"compact-{self._compactions()}"
        names = [r["table"] for r in self._live().collect()]
        if len(names) > 1:
            made = self._write(self._sums(self.spark.createDataFrame([(n,) for n in names], "table string")))
            self._enter(entry, ["+" + made, *("-" + n for n in names)])

    def _compactions(self) -> int:
        store, path = self._store("log")
        return sum(x.getPath().getName().startswith("compact-") for x in store.listStatus(path))
