"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import datetime
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import public_tokenizers as P  # noqa: E402

from pairwave.llm import bpe, chat, linededup, orderhash, pii, quality, simhash, tokencount, tokens  # noqa: E402
from pairwave.llm.common import components, shared_folder, with_order  # noqa: E402

KEY = b"sixteen bytes or more"
LONG = "\n".join(f"Line {i % 700} of {i % 300} long ones, with words that come again." for i in range(6000))
TEXTS = [
    None, "", " \t\n ", "one", "Ünï cödé 漢字 \U0001f600 words", "a b c d e f g", "a b c d e f g", "x\ny\nz", LONG,
    "call +1 604 555 0199 or mail Ann.Lee@example.org by 2021-02-28", "<|end|> [INST] \\l </s>", "same same same same same",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, clean_text string, ids string, n_found string, removed_lines string, kept string, fp string, __x string"


@pytest.fixture(scope="module")
def odd(spark):
    """TEXTS, one row twice over, a null doc_id, other columns null or named like outputs."""
    rows = [(i, t, None, "s", None, "mine", "mine", "mine", "mine", "mine", "mine", None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "a b c d e f g", None, None, None, *["mine"] * 6, None)]
    made = shared_folder(spark, "odd")
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.parquet(made)
    return spark.read.parquet(made)


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.where("false")


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def given_texts(odd):
    return [(r.doc_id, r.text) for r in rows_of(odd)]


def test_quality(odd, empty):
    for r, (_, text) in zip(rows_of(quality.clean_lines(odd)), given_texts(odd)):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text)
        assert r.clean_text != "mine" and r.ids == "mine"
    assert quality.clean_lines(empty).collect() == []


def test_quality_verdicts():
    good = "\n".join(f"Sentence {i} has {i}a words {i}b of {i}c its {i}d own." for i in range(20))
    menu = "\n".join(["Home | About | Shop | Contact"] * 3)
    assert quality.judge(good, 0.4, 0.5, 0.4)[-1]
    assert quality.judge(good + "\n" + menu, 0.4, 0.5, 0.4)[0] == good
    assert not quality.judge(good + "\n" + menu * 30, 0.4, 0.5, 0.4)[-1]
    assert quality.line_fails("Please accept cookies and our privacy policy.", 0.5, 0.4) == "boilerplate"
    assert quality.line_fails("no end of a sentence", 0.5, 0.4) == "punctuation"
    assert quality.line_fails("A heading", 0.5, 0.4, "It is followed by a sentence.") is None
    assert quality.line_fails("  2) an item of a list", 0.5, 0.4) is None and quality.line_fails("- another", 0.5, 0.4) is None
    assert quality.line_fails("A sentence. And the start of one", 0.5, 0.4) is None
    assert quality.line_fails("Alle Rechte vorbehalten.", 0.5, 0.4) == "boilerplate"


def test_line_dedup(odd, empty):
    got = rows_of(linededup.remove_repeated_lines(odd))
    texts = given_texts(odd)
    # the null doc_id comes first in the operator's order
    order = [texts[-1], *texts[:-1]]
    want = brute.without_repeats([t for _, t in order])
    want = [*want[1:], want[0]]
    assert [r.text for r in got] == want
    assert all(r.removed_lines != "mine" for r in got)
    assert linededup.remove_repeated_lines(empty).collect() == []


def _lines(spark, texts):
    at = shared_folder(spark, "lines")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(at)
    return spark.read.parquet(at)


@pytest.mark.parametrize("least", [1, 5, 50])
def test_line_dedup_on_small_alphabets(spark, least):
    rng = random.Random(least)
    texts = ["\n".join(rng.choice(["a", "b b", "c", "", "d d d d d d"]) for _ in range(rng.randrange(25))) for _ in range(40)]
    # passages longer than any power of two of the rounds, cut at either end
    whole = [f"line {i % 19} of a passage" for i in range(37)]
    texts += ["\n".join([*texts[i].split("\n"), *whole[rng.randrange(9) : 37 - rng.randrange(9)], *texts[-i].split("\n")]) for i in range(12)]
    docs = _lines(spark, texts)
    got = rows_of(linededup.remove_repeated_lines(docs, least))
    assert [r.text for r in got] == brute.without_repeats(texts, least)
    runs = {(r.doc_id, r.start, r.lines) for r in linededup.repeated_runs(docs, least).collect()}
    assert runs == brute.repeated_runs(texts, least)


def test_runs_of_lines_are_reported(spark):
    text = "one two three four five\nunique here\none two three four five\nsix seven eight nine ten\nend of it"
    more = "head\none two three four five\nsix seven eight nine ten"
    got = rows_of(linededup.remove_repeated_lines(_lines(spark, [text, more]), 5))
    assert [[tuple(x) for x in r.removed_runs] for r in got] == [[(2, 1)], [(1, 2)]]
    assert got[1].text == "head"


def test_short_repeats_stay_and_long_passages_go(spark):
    common = "\n".join(f"this is sentence {i} of the passage that all share" for i in range(7))
    texts = [f"own words {i}\nAll rights reserved.\n{common}\nmore own words {i}" for i in range(5)]
    got = rows_of(linededup.remove_repeated_lines(_lines(spark, texts)))
    assert got[0].text == texts[0]
    assert [r.text for r in got[1:]] == [f"own words {i}\nmore own words {i}" if False else t.replace("All rights reserved.\n" + common + "\n", "") for t in texts[1:]]


def test_simhash(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(TEXTS) + 2
    texts = given_texts(odd)
    prints = [brute.fingerprint(t) for _, t in texts]
    root = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (d, _), g in zip(texts, root):
        least[g] = d if least.get(g) is None else min(least[g], d if d is not None else least[g])
    want = sorted(((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(texts, prints, root)), key=repr)
    assert sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got), key=repr) == want
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(root))
    assert simhash.keep_one(empty).collect() == []


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=20), st.integers(0, 4), st.randoms())
@settings(max_examples=60, deadline=None)
def test_anchors_cover_four_bits(values, flips, rng):
    pairs = []
    for v in values:
        w = v
        for b in rng.sample(range(64), flips):
            w ^= 1 << b
        pairs.append((v, w))
    fps = np.array([x for p in pairs for x in p], np.uint64)
    row, key, home = simhash.anchors(fps)
    at_home = {(int(fps[r]), k) for r, k, h in zip(row, key.tolist(), home) if h}
    there = {(int(fps[r]), k) for r, k in zip(row, key.tolist())}
    for v, w in pairs:
        assert any((v, k) in at_home and (w, k) in there for _, k in {x for x in there if x[0] == v})


def test_blocks_of_one_anchor_join_all(spark):
    values = [(1 << i) - 1 & 15 | (j << 40) for i in range(5) for j in range(4)]
    df = spark.createDataFrame([(v,) for v in set(values)], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, block=2)).collect()}
    names = sorted(set(values))
    want = brute.groups(names, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {v: found.get(v, v) for v in names} == {v: names[g] for v, g in zip(names, want)}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def test_order_is_dense(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "k long, v long").repartition(7)
    got = sorted((r.k, r.at) for r in with_order(df, "k", "v", name="at").collect())
    assert [a for _, a in got] == list(range(1000))


def test_order_minhash(odd, empty):
    got = rows_of(orderhash.compare_with_edits(odd))
    assert [r.fingerprint for r in got] == [brute.order_minhash(t) for _, t in given_texts(odd)]
    assert got[0].fingerprint == got[1].fingerprint == "" and got[1].near_next == 1.0
    assert orderhash.compare_with_edits(empty).collect() == []
    one = rows_of(orderhash.compare_with_edits(odd.where("doc_id = 4")))[0]
    assert one.near_next == 1.0


def test_order_matters(spark):
    ws = [f"w{i}" for i in range(200)]
    texts = [" ".join(ws), " ".join(ws[100:] + ws[:100]), " ".join(ws[:150])]
    sigs = [r.s for r in spark.createDataFrame([(t,) for t in texts], "text string").select(orderhash.as_text(orderhash.signature(F.col("text"))).alias("s")).collect()]
    assert brute.likeness(sigs[0], sigs[2]) > brute.likeness(sigs[0], sigs[1])


def test_pii(odd, empty):
    done = pii.protect(odd, KEY)
    got = rows_of(done)
    assert got[0].text is None and got[1].text == "" and all(isinstance(r.n_found, int) for r in got)
    assert [r.n_found for r in got if r.doc_id == 9] == [3]
    back = rows_of(pii.protect(done, KEY, undo=True))
    assert [(r.text or "").lower() for r in back] == [(t or "").lower() for _, t in given_texts(odd)]
    assert pii.protect(empty, KEY).collect() == []


def test_feistel_permutes():
    f, g = pii.Feistel(KEY), pii.Feistel(KEY, undo=True)
    for size in (1, 2, 3, 10, 97, 1000):
        made = [f.number(x, size, "t") for x in range(size)]
        assert sorted(made) == list(range(size))
        assert [g.number(x, size, "t") for x in made] == list(range(size))
    assert {f.text(f"{x:03d}", pii.DIGITS, "d") for x in range(1000)} == {f"{x:03d}" for x in range(1000)}
    with pytest.raises(ValueError):
        pii.Feistel(b"short")


def test_formats_are_kept():
    f = pii.Feistel(KEY)
    text = "4111 1111 1111 1111, 4111-1111-1111-1111; GB82 WEST 1234 5698 7654 32 on 29.02.2020, 078-05-1120, 192.168.0.1"
    made, n = pii.pseudonymise(text, f)
    assert n == 6
    first, second = made.split("; ")[0].split(", ")
    assert first.replace(" ", "") == second.replace("-", "") != "4" + "1" * 15 and pii.luhn(first.replace(" ", ""))
    day = made.split(" on ")[1].split(",")[0]
    datetime.datetime.strptime(day, "%d.%m.%Y")
    same, none = pii.pseudonymise("4111 1111 1111 1112, 999.1.1.1, 31.02.2020, GB00 WEST 1234 5698 7654 32", f)
    assert none == 0 and same.startswith("4111 1111 1111 1112")


def test_token_counts(spark, odd, empty):
    folder = shared_folder(spark, "rollup")
    rollup = tokencount.Rollup(spark, folder)
    assert rollup.totals().collect() == []
    path = P.path("word_bpe_49k.json")
    counts = tokencount.inserts(tokencount.counted(odd, {"words-1": None, "bpe": path}), "words-1", "bpe")
    assert rollup.commit("a/1", counts) and not rollup.commit("a/1", counts)
    texts = [t for _, t in given_texts(odd)]
    want = {"words-1": sum(len(brute.words(t)) for t in texts), "bpe": sum(map(len, brute.token_ids(texts)))}

    def total():
        rows = rollup.totals().groupBy("tokenizer").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).collect()
        assert all(r.d == len(TEXTS) + 2 for r in rows)
        return {r.tokenizer: r.t for r in rows}

    assert total() == want
    none = tokencount.inserts(tokencount.counted(empty, {"words-1": None}), "words-1")
    assert rollup.commit("a/2", none) and total() == want
    rollup.compact()
    assert total() == want and not rollup.commit("a/1", counts)
    # a table that no log entry names, as of a batch that failed or that another writer committed first, does not count
    rollup._write(counts)
    assert total() == want
    assert not rollup._enter("batch-a%2F1", ["+" + "0" * 32]) and total() == want
    rollup.compact()
    assert rollup.commit("a/3", tokencount.deletes(counts))
    assert rollup.totals().collect() == []


def _library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY, CODEC = _library(), bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@given(st.text(st.sampled_from("ab \n\t'sé漢  x1. ") | st.characters(exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_is_the_librarys(text):
    ids = CODEC.encode([text])[0]
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_bpe_of_long_matches():
    for text in ("a" * 3000, "ab" * 999 + "c", "".join(random.Random(5).choice("abcdeghi") for _ in range(5000)), "漢字" * 700):
        assert CODEC.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_bpe(odd, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    for r, (_, text) in zip(rows_of(bpe.encode(odd, path, P.PATTERN, decoded=True)), given_texts(odd)):
        assert list(r.ids) == LIBRARY.encode_ordinary(text or "") and bytes(r.decoded) == (text or "").encode()
    assert bpe.encode(empty, path, P.PATTERN).collect() == []


def test_packing(odd, empty):
    path = P.path("word_bpe_49k.json")
    want = sorted(n for x in brute.token_ids([t for _, t in given_texts(odd)]) for n in tokens.pieces_of(len(x) + 1, 4096))
    got = tokens.pack(odd, path).collect()
    assert sorted(r.length for r in got) == want and len({r.sequence_id for r in got}) == len(got)
    assert tokens.pack(empty, path).collect() == []
    with pytest.raises(ValueError):
        tokens.pack(odd, path, longest=3000)


WORD_BPE = tokens.Encoder(P.path("word_bpe_49k.json"))


@given(st.lists(st.lists(st.sampled_from("abHST '\x01\n\u0301\u0331.7İ") | st.characters(exclude_categories=["Cs"]) | st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|"]), max_size=30).map("".join) | st.just("a <|endoftext|> B"), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_pieces_are_encoded_as_whole_texts(texts):
    want = brute.token_ids(texts)
    assert [x.tolist() for x in WORD_BPE.encode(texts)] == [x.tolist() for x in want]


@given(st.integers(0, 100_000), st.sampled_from([1, 2, 64, 4096]))
def test_powers_of_two(n, longest):
    parts = tokens.pieces_of(n, longest)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= longest for p in parts) and parts == sorted(parts, reverse=True)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(1000, 1100), min_size=1, max_size=400), st.sampled_from([0.0, 50.0, 95.0, 100.0]))
@settings(deadline=None)
def test_blocks_round_trip(values, percentile):
    raw = tokens.encode_block(np.array(values, np.uint32), percentile)
    back, at = tokens.decode_block(b"xyz" + raw, 3)
    assert back.tolist() == values and at == len(raw) + 3


def test_files_round_trip():
    sink = pa.BufferOutputStream()
    writer = tokens.ShardWriter(sink, 95.0)
    rng = np.random.default_rng(1)
    docs = [(i if i != 3 else None, rng.integers(0, 49408, n).astype(np.int32)) for i, n in enumerate([0, 1, 5000, 7, 300_000, 4096])]
    for d, x in docs:
        writer.add(d, x)
    assert writer.close()[:2] == (sum(len(x) for _, x in docs), 6)
    back = list(tokens.read_shard(pa.BufferReader(sink.getvalue())))
    assert [d for d, _, _ in back] == [d for d, _ in docs]
    assert all((a == b).all() for (_, a), (_, _, b) in zip(docs, back))
    with pytest.raises(ValueError):
        list(tokens.read_shard(pa.BufferReader(b"x" * 100)))


def test_token_files(spark, odd, empty):
    path = P.path("word_bpe_49k.json")
    folder = shared_folder(spark, "files")
    got = rows_of(tokens.read_token_files(spark, tokens.write_token_files(odd, path, folder), folder))
    assert [r.n_tokens for r in got] == [len(x) + 1 for x in brute.token_ids([t for _, t in given_texts(odd)])]
    folder = shared_folder(spark, "files")
    assert tokens.read_token_files(spark, tokens.write_token_files(empty, path, folder), folder).collect() == []


def test_chat(spark):
    rows = [
        (1, 0, "system", "Be <kind>"), (1, 1, "user", "</s>[INST] \\l \\\\ <|end|>\n"), (1, 2, "assistant", None), (1, 2, "assistant", None),
        (2, None, None, "no role"), (2, 1, "tool<|>\n[x]", "odd"), (None, 0, "user", "hi"), (3, 0, "assistant", "first"),
    ]
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "conv_id long, turn long, role string, text string, valid string, segments string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r, t or "") for _, _, r, t in rows[:4]]
    assert [tuple(t) for t in got[2].turns] == [("", "no role"), ("tool<|>\n[x]", "odd")]
    assert {k: r.valid for k, r in got.items()} == {1: False, 2: False, 3: False, None: True}
    assert got[1].formatted == "".join(s.text for s in got[1].segments)
    assert [s.text for s in got[3].segments if s.loss] == ["first"]
    assert chat.format_chats(df.where("false")).collect() == []


@given(st.lists(st.text(st.sampled_from("\\<[l b|>a\n") | st.characters(exclude_categories=["Cs", "Cc"]), max_size=20), min_size=1, max_size=20))
@settings(max_examples=10, deadline=None)
def test_escapes_are_undone(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "<" not in r.e and "[" not in r.e for r in got)
