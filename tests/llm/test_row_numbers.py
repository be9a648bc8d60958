"""Rows are numbered once: cutting the files otherwise between two reads of the input changes nothing."""

import contextlib

import pytest

from pairwave.llm import linededup, orderhash, shingles, simhash
from pairwave.llm.common import shared_folder


@contextlib.contextmanager
def _setting(spark, key, value):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@pytest.mark.parametrize("step", [linededup.remove_repeated_lines, orderhash.compare_with_edits, simhash.keep_one, shingles.keep_one])
def test_files_cut_otherwise(spark, step):
    at = shared_folder(spark, "cut")
    texts = [f"common first line of each text\nline {i} has words of its own {i * 7} and {i * 13}\n{'more ' * (i % 5)}{i}" for i in range(60)]
    texts += texts[:20]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(at)
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    want = sorted(map(repr, step(spark.read.parquet(at)).collect()))
    with _setting(spark, size, "1g"), _setting(spark, cost, "0"), _setting(spark, "spark.sql.files.minPartitionNum", "1"):
        later = step(spark.read.parquet(at))
    with _setting(spark, size, "2k"), _setting(spark, cost, "2k"):
        assert sorted(map(repr, later.collect())) == want
