"""Decontamination against a plain version: hits, spans and what is left of texts; with and without broadcasts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pairwave.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PIECE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    """{doc: (n_words, n_hit, items, spans, text without the spans)}"""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(size, len(w)) + 1):
            if w:
                windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = {}
    for d, text in docs:
        w, hit, named = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(w[i : i + n])]
        starts = [i for i in sorted(hit) if i - 1 not in hit]
        spans = [(s, next(k for k in range(s, len(w) + 1) if k not in hit) - s) for s in starts]
        left = text
        if spans:
            pieces = PIECE.findall(text)
            first = 0 if WORD.match(pieces[0].lower()) else 1
            gone = {2 * k + first + e for k in hit for e in (0, 1)}
            left = "".join(p for j, p in enumerate(pieces) if j not in gone)
        out[d] = (len(w), len(hit), sorted(named), spans, left)
    return out


def found(df):
    return {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), [tuple(s) for s in r.spans], r.text) for r in df.collect()}


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def texts():
    g = random.Random(8)
    some = lambda n: " ".join(g.choice("ab ba Ca, d1 éÉ \U00010400x f.".split()) for _ in range(n))
    items = [(i, some(g.choice([0, 1, 3, 4, 5, 12]))) for i in range(12)] + [(3, some(6)), (None, some(5)), (77, None), (78, "")]
    docs = [(i, some(g.choice([0, 1, 4, 30, 60]))) for i in range(50)]
    docs += [(100, None), (101, ""), (102, " . "), (103, f"({items[5][1]})"), (104, "\n\n" + items[4][1] + "; end"), (105, "q " * 20_000 + items[5][1]), (106, items[6][1])]
    return docs, items


@pytest.mark.parametrize("size", [4, 10, 1])
def test_against_the_plain_version(spark, texts, size):
    docs, items = texts
    df, bench = tables(spark, docs, items)
    want = plain(docs, items, size)
    got = found(dc.decontaminate(df, bench, size))
    assert got == want and any(v[1] for v in want.values()) and any(not v[1] for v in want.values())


def test_without_broadcasts(spark, texts, monkeypatch):
    monkeypatch.setattr(dc, "MOST_GRAMS", 0)
    monkeypatch.setattr(dc, "MOST_BYTES", -1)
    docs, items = texts
    df, bench = tables(spark, docs, items)
    out = dc.decontaminate(df, bench, 4)
    assert found(out) == plain(docs, items, 4)


def test_hashes_do_not_decide(spark, texts, monkeypatch):
    # as if every window of the benchmark had each document window's hash
    monkeypatch.setattr(dc, "_window_hashes", lambda h, n: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.lit(7).cast("long"))))
    real = dc.grams
    monkeypatch.setattr(dc, "grams", lambda b, size: real(b, size).withColumn("h", F.lit(7).cast("long")))
    docs, items = [x for x in texts[0] if x[0] < 101], texts[1]
    df, bench = tables(spark, docs, items)
    assert found(dc.decontaminate(df, bench, 4)) == plain(docs, items, 4)


def test_what_is_removed(spark):
    docs = [(1, "keep one two three four keep"), (2, "clean text only"), (2, "clean text only")]
    df, bench = tables(spark, docs, [(9, "One, two; THREE four")])
    whole = dc.decontaminate(df, bench, 4)
    assert sorted(r.text for r in whole.collect()) == ["clean text only", "clean text only", "keep keep"]
    assert sorted(r.text for r in dc.decontaminate(df, bench, 4, remove="documents").collect()) == ["clean text only"] * 2
    marked = dc.decontaminate(df, bench, 4, remove="nothing").where("contaminated").first()
    assert marked.text == docs[0][1] and [tuple(s) for s in marked.spans] == [(1, 4)] and list(marked["items"]) == ["9"]
    with pytest.raises(ValueError):
        dc.decontaminate(df, bench, 4, remove="all")


def test_empty_tables_and_clashing_names(spark):
    df, bench = tables(spark, [(1, "a b c d")], [(1, "a b")])
    assert found(dc.decontaminate(df.where("false"), bench)) == {}
    assert found(dc.decontaminate(df, bench.where("false"))) == {1: (4, 0, [], [], "a b c d")}
    odd = df.select("*", F.lit(5).alias("SPANS"), F.lit(6).alias("found"), F.lit(7).alias("__row"), F.lit(8).alias("doc"), F.lit(9).alias("n_hit"), F.lit(1).alias("h"))
    more = bench.select("*", F.lit(5).alias("size"), F.lit("x").alias("gram"), F.lit("y").alias("items"))
    row = dc.decontaminate(odd, more, 2).first()
    assert row.n_hit == 2 and (row["found"], row["__row"], row["doc"], row["h"]) == (6, 7, 8, 1) and row.text == "c d"
