"""The pipeline against its stages written plainly, and its stages on odd tables."""

import sys
import zlib
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_edges import SCHEMA, TEXTS  # noqa: E402

import corpus_pipeline  # noqa: E402
from pairwave.llm import pii, quality  # noqa: E402
from pairwave.llm.common import shared_folder  # noqa: E402


def _shingles(text):
    ws = brute.words(brute.lower_ascii(text))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def _alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_run(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    judged = [(d, brute.verdict(t, quality.BOILERPLATE)) for d, t in docs]
    docs = [(d, j[0]) for d, j in judged if j[-1]]
    shorter = brute.without_repeats([t for _, t in docs], 50)
    docs = [(d, n) for (d, t), n in zip(docs, shorter) if t == n or n.strip(" ")]
    group = brute.groups([_shingles(t) for _, t in docs], _alike)
    docs = [x for i, x in enumerate(docs) if group[i] == i]
    f = pii.Feistel(corpus_pipeline.KEY)
    docs = [(d, pii.pseudonymise(t, f)[0]) for d, t in docs]
    want = {d: np.append(x, np.uint32(2)).astype("<u4").tobytes() for (d, _), x in zip(docs, brute.token_ids([t for _, t in docs]))}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {d: zlib.crc32(b"".join(x for _, x in sorted(v))) for d, v in got.items()} == {d: zlib.crc32(x) for d, x in want.items()}


def test_stages_take_odd_tables(spark, sf):
    rows = [(i, t, None, "s", None, "mine", "mine", "mine", "mine", "mine", "mine", None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, None, None, None, None, *["mine"] * 6, None)]
    for some in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            at = shared_folder(spark, name)
            spark.createDataFrame(some, SCHEMA).write.parquet(at)
            docs = spark.read.parquet(at)
            made = stage(spark, docs, sf)
            assert name == "packing" or made.columns == docs.columns
            assert (made.count() > 0) == (bool(some) and name != "quality_rules") or name == "quality_rules"


def test_clean_documents_stay(spark, sf):
    clean = "\n".join(f"Chapter {i} tells {i}a how {i}b river {i}c was {i}d crossed {i}e." for i in range(12))
    docs = [(i, "\n".join(f"{x} {i}{k}." for k, x in enumerate(clean.split("\n"))), "en", "s", 0) for i in range(3)]
    at = shared_folder(spark, "clean")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(at)
    kept = corpus_pipeline.quality_rules(spark, spark.read.parquet(at), sf)
    assert {r.doc_id: r.text for r in kept.collect()} == {d: t for d, t, *_ in docs}
