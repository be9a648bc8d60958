"""The training-data pipeline: quality rules, line dedup, near dedup, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is written and read
again as the docs of the next. All but the last return the columns of documents, with n_chars for the text as it then is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwave.llm import linededup, pii, quality, shingles, tokens
from pairwave.llm.common import shared_folder, table

#: The pipeline's key for pseudonyms. A real run sets its own secret here.
KEY = b"pairwave pipeline key, not secret"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and with them the documents that fail or lose too much."""
    kept = quality.clean_lines(_apart(docs)).where("kept")
    return _whole(kept, docs, "clean_text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; a document of which nothing but such copies was left goes too.

    Shorter runs stay here: they are mostly lines that single rules judged already, and near copies that lost a line each
    would no longer be near copies.
    """
    done = linededup.remove_repeated_lines(_apart(docs), min_words=50)
    return _whole(done.where("removed_lines = 0 or trim(text) <> ''"), docs, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of five-word shingles 0.8 or more) stays.

    SimHash anchors and bands of minima propose pairs, the exact similarity decides: a limit of 4 bits alone, as op7's
    contract sets it, holds none of the pairs of 0.8 or more that this stage meets on sf0.1.
    """
    return shingles.keep_one(docs, words=5, least=0.8)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses are permuted within their formats."""
    return _whole(pii.protect(_apart(docs), KEY), docs, "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token IDs of power-of-two lengths."""
    return tokens.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what else docs has as one column, so that no operator's own columns clash with it."""
    rest = [docs[c] for c in docs.columns if c.lower() not in ("doc_id", "text", "n_chars")]
    return docs.select("doc_id", "text", *[F.struct(*rest).alias("rest")] * bool(rest))


def _whole(done: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs from rows of _apart, text taken from the named column and n_chars counted anew."""
    new = {"doc_id": F.col("doc_id"), "text": F.col(text), "n_chars": F.length(text).cast("long")}
    return done.select(*[(new[c.lower()] if c.lower() in new else F.col("rest")[c]).alias(c) for c in docs.columns])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("packing", packing),
]

#: Fingerprints, Feistel networks and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
