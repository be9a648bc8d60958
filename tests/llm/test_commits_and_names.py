"""Commits that stop at any step or meet others; markers in capitals; dates however written; names that clash."""

import datetime
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairwave.llm import bpe, linededup, pii, quality, tokencount, tokens

KEY = b"0123456789abcdef"


def deltas(spark, n):
    return spark.createDataFrame([("s", "en", "words-1", 1, 10)] * n, tokencount.SCHEMA)


def totals(rollup):
    return [(r.docs, r.tokens) for r in rollup.totals().collect()]


def test_a_writer_that_dies_leaves_no_entry(spark, tmp_path, monkeypatch):
    rollup = tokencount.Rollup(spark, f"file://{tmp_path}/r")
    real = rollup._draft

    def dies(lines):
        real(lines)
        raise RuntimeError("the driver died")

    monkeypatch.setattr(rollup, "_draft", dies)
    with pytest.raises(RuntimeError):
        rollup.commit("b", deltas(spark, 1))
    monkeypatch.setattr(rollup, "_draft", real)
    assert totals(rollup) == []
    assert rollup.commit("b", deltas(spark, 1)) and not rollup.commit("b", deltas(spark, 1))
    assert totals(rollup) == [(1, 10)]


def test_two_compactions_and_a_commit_between_them(spark, tmp_path, monkeypatch):
    rollup = tokencount.Rollup(spark, f"file://{tmp_path}/r")
    for b in ("b", "c"):
        rollup.commit(b, deltas(spark, 1))
    held, enter = [], rollup._enter
    monkeypatch.setattr(rollup, "_enter", lambda *x: held.append(x) or True)
    rollup.compact()
    monkeypatch.setattr(rollup, "_enter", enter)
    rollup.commit("a", deltas(spark, 1))
    rollup.compact()
    assert [enter(*x) for x in held] == [False] and totals(rollup) == [(3, 30)]
    rollup.commit("d", deltas(spark, 2))
    rollup.compact()
    assert totals(rollup) == [(5, 50)] and not rollup.commit("a", deltas(spark, 9))


def test_markers_in_capitals():
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    encode, g = tokens.encoder(P.path("word_bpe_49k.json")).encode, random.Random(3)
    parts = ["<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", " ", "foo", "Bar", "<|", "|>", "é", "\x01", "\n", "É"]
    texts = ["".join(g.choice(parts) for _ in range(g.randrange(9))) for _ in range(3000)]
    assert [x.tolist() for x in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_dates_are_linked_however_written():
    f, back, g = pii.Feistel(KEY), pii.Feistel(KEY, True), random.Random(4)
    for _ in range(1500):
        day = datetime.date(1900, 1, 1) + datetime.timedelta(days=g.randrange(73_049))
        formats = ["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", *["%d/%m/%Y"] * (day.day > 12)]
        made = [pii.pseudonymise(day.strftime(x), f)[0] for x in formats]
        new = datetime.date.fromisoformat(made[0])
        assert made == [new.strftime(x) for x in formats]
        assert [pii.pseudonymise(x, back)[0] for x in made] == [day.strftime(x) for x in formats]


def test_clashing_names(spark):
    names = ["N_FOUND", "__text", "text_", "IDS", "__n0", "n0", "v0", "N_LINES", "clean_text", "doc", "__row"]
    df = spark.createDataFrame([(1, "A plain line that ends well, on 2001-02-03.", "s", "en", *range(len(names)))], ["doc_id", "text", "source", "lang", *names])
    keep = [c for c in names if c not in ("N_FOUND",)]
    row = pii.protect(df, KEY).first()
    assert row.n_found == 1 and [row[c] for c in keep] == [names.index(c) for c in keep]
    row = bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first()
    assert len(row["ids"]) > 5 and row["__text"] == 1 and row["N_FOUND"] == 0
    row = quality.clean_lines(df).first()
    assert row["clean_text"].startswith("A plain") and row["__text"] == 1 and row["IDS"] == 3
    row = tokencount.counted(df, {"words-1": None, "v": P.path("word_bpe_49k.json")}, tuple(names)).first()
    assert [row[c] for c in names] == list(range(len(names))) and [x.tokens for x in row.counts][0] == 8
    row = linededup.remove_repeated_lines(df).first()
    assert row.n_lines == 1 and row["doc"] == names.index("doc")


def test_pipeline_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    text = " ".join(f"Word{i} follows word{i + 1} here." for i in range(40))
    df = spark.createDataFrame([(1, text, len(text), 6, 7, 8, 9)], ["doc_id", "text", "n_chars", "kept", "clean_text", "n_found", "removed_lines"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, df, "").collect()
        assert len(done) == 1 and done[0].asDict() == df.first().asDict(), name


def test_line_dedup_takes_single_lines(spark):
    line = "one two three four five"
    df = spark.createDataFrame([(1, f"{line}\nfew words"), (2, f"other\n{line}\nfew words")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.remove_repeated_lines(df).collect()) == [(1, f"{line}\nfew words"), (2, "other")]
    assert sorted(r.removed_lines for r in linededup.remove_repeated_lines(df, 50).collect()) == [0, 0]
    assert sorted(r.words for r in linededup.repeated_runs(df, 5).collect()) == [7, 7]


def test_word_counts_up_to_a_limit(spark):
    lines = ["", "  ", "a", " a b", "a\tb c ", "a b c d", "\x0ba b c d e f", "a b"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = df.select("x", *[linededup._words(F.col("x"), m).alias(f"m{m}") for m in (None, 1, 3, 50)]).collect()
    for r in got:
        n = len(r.x.split())
        assert (r.mNone, r.m1, r.m3, r.m50) == (n, min(n, 1), min(n, 3), n)
