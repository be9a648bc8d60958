"""The near-dedup stage on non-identical copies whose SimHashes are far apart."""

import random

import corpus_pipeline
from pairwave.llm.common import shared_folder


def _kept(spark, texts):
    at = shared_folder(spark, "near")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(at)
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(at), "").collect())


def _edited(words, places):
    return " ".join(f"edit{i}" if i in places else w for i, w in enumerate(words))


def test_copies_from_the_limit_on_go_and_others_stay(spark):
    rng = random.Random(448)
    texts, want = [], []
    for d in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        # 196 shingles, five fewer in common for each edit: 4 edits give 176 / 216 = 0.81, 5 give 171 / 221 = 0.77
        places = range(20, 180, 40) if d % 2 else range(20, 180, 32)
        want += [2 * d] if d % 2 else [2 * d, 2 * d + 1]
        texts += [" ".join(words), _edited(words, set(places))]
    assert _kept(spark, texts) == want


def test_a_common_bucket_is_linked_whole(spark):
    rng = random.Random(449)
    heads = [[f"v{rng.randrange(5000)}" for _ in range(200)] for _ in range(3)]
    # 60 copies with one edit each, of every head: no two alike, all within 186 / 206 of each other
    texts = [_edited(h, {10 + 3 * i}) for h in heads for i in range(60)]
    assert _kept(spark, texts) == [0, 60, 120]


def test_blocks_find_what_the_centres_miss(spark):
    """A chain of sets, each similar to its neighbours only, in buckets of one key and blocks of two sets a side."""
    from pairwave.llm import shingles

    held = [(i, list(range(10 * i, 10 * i + 100))) for i in range(12)]
    rows = [(1, i, i, 0) for i, _ in held]
    spans = spark.createDataFrame(rows, "key long, set long, root long, of long")
    sets = spark.createDataFrame(held, "set long, shingles array<long>")
    got = {tuple(sorted((r.u, r.v))) for r in shingles._in_blocks(spans, sets, 0.8, 2).collect()}
    assert got == {(i, i + 1) for i in range(11)}
