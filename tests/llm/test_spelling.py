"""Spelling variants against a plain version over all pairs of words, and by blocks and batches of any size."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pairwave.llm import queries, spelling


def near_to(words):
    """For each word those one inserted, deleted or replaced code point away."""
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= holes[w[:i] + "\0" + w[i + 1 :]] - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def grouped(words, ratio=10):
    near, form = near_to(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def counted(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = grouped(counted(docs))
    assert found(queries.op12_spelling(spark, sf)) == want
    assert any(v[2] for v in want.values())


@pytest.mark.parametrize("block,merged", [(4096, 2_000_000), (7, 40), (1, 1)])
def test_blocks_and_batches_change_nothing(spark, monkeypatch, block, merged):
    # functions travel to the workers with the values that they have here
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "MERGED", merged)
    g = random.Random(3)
    words = {}
    for length in (6, 7, 8, 9, 10):
        for _ in range(60):
            words["".join(g.choice("aabé") for _ in range(length))] = g.choice([1, 2, 30, 400, 5000])
    df = spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3)
    assert found(spelling.group_variants(df)) == grouped(words)


def test_chains_ties_and_long_words(spark):
    words = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10_000, "aabbbbb": 100_000, "zzzzzzz": 1, "zzzzzzy": 10, "zzzzzzx": 10, "zzzzzzzz": 9}
    words |= {"q" * 3000: 2, "q" * 2999 + "r": 50, "abcdefg": 5, "bacdefg": 500}
    got = found(spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words)
    assert got["aaaaaaa"][4] == "aabbbbb" and got["zzzzzzz"][2] == "zzzzzzx" and got["q" * 3000][4] == "q" * 2999 + "r" and got["abcdefg"][2] is None


def test_counting_and_empty_tables(spark):
    df = spark.createDataFrame([("longword", 1), ("longword", 2), (None, 3), ("short", 4), ("short", 5), ("onlyonce", 6)], "word string, n long")
    assert [tuple(r) for r in spelling.count_words(df).collect()] == [("longword", 2)]
    assert spelling.group_variants(spelling.count_words(df.where("false"))).collect() == []
    one = spelling.group_variants(spark.createDataFrame([("wording", 3)], "word string, n int")).collect()
    assert [tuple(r) for r in one] == [("wording", 3, 0, None, None, "wording")]


def test_null_ids_and_texts(spark, tmp_path):
    docs = [(None, "Straßenbahn Straßenbahn ÉTAGEREX ÉTAGEREX"), (1, None), (2, ""), (3, "x" * 200_000 + " tail-word tailword tailword")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert found(queries.op12_spelling(spark, str(tmp_path))) == grouped(counted(docs))
