"""Every query of the training-data operators: against its SQL, or a plain version over the whole table."""

import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from harness import assert_same, database  # noqa: E402

from pairwave.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def found(name, spark, sf):
    return queries.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), database(sf), queries.ORACLES[name])


def test_token_counts(spark, sf, docs):
    keys = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, seen = {}, set()
    for (d, text), ids in zip(docs, brute.token_ids([t for _, t in docs])):
        if text not in seen:
            seen.add(text)
            for name, n in (("bytes-1", len((text or "").encode())), ("word_bpe_49k", len(ids))):
                count = want.setdefault((*keys[d], name), [0, 0])
                count[0] += 1
                count[1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in found("op2_token_counts", spark, sf)}
    assert got == want


def test_pii_leaves_nothing_and_can_be_undone(spark, sf, docs):
    from pairwave.llm import pii

    done = queries.op3_pii(spark, sf)
    rows = {r.doc_id: r for r in done.collect()}
    assert len(rows) == len(docs)
    for d, text in docs:
        assert (rows[d].text == text) == (rows[d].n_found == 0)
        assert rows[d].n_found > 0 or not pii._ANY.search(text) or all(c is None for c in _changes(text))
    back = {r.doc_id: r.text for r in pii.protect(done.drop("n_found"), b"op3 demonstration key, not secret", undo=True).collect()}
    changed = [d for d, t in docs if back[d].lower() != t.lower()]
    assert not changed


def _changes(text):
    from pairwave.llm import pii

    f = pii.Feistel(b"0123456789abcdef")
    return [pii.KINDS[int(m.lastgroup[1:])][2](f, m[0]) for m in pii._ANY.finditer(text)]


def test_bpe_is_the_librarys(spark, sf, docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in found("op4_byte_bpe", spark, sf)}
    assert len(got) == len(docs)
    for d, text in docs:
        ids = library.encode_ordinary(text or "")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_packing_holds_every_id_once(spark, sf, docs):
    ids = dict(zip([d for d, _ in docs], brute.token_ids([t for _, t in docs])))
    pieces = {}
    for r in found("op6_packing", spark, sf):
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.length <= 4096 and r.length & (r.length - 1) == 0 and r.offset == 0
    names = [r.sequence_id for rows in pieces.values() for r in rows]
    assert len(set(names)) == len(names)
    assert set(pieces) == set(ids)
    for d, rows in pieces.items():
        whole, at = np.append(ids[d], np.uint32(2)).astype("<u4"), 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            assert r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)


def test_simhash_components(spark, sf, docs):
    component, prints = brute.simhash_components(docs)
    got = found("op7_simhash", spark, sf)
    assert {r.doc_id: r.component_id for r in got} == component
    assert {r.doc_id: r.fingerprint for r in got} == prints


def test_order_minhash(spark, sf, docs):
    got = {r.doc_id: r for r in found("op8_order_minhash", spark, sf)}
    assert len(got) == len(docs)
    near_edited, near_next = [], []
    for i, (d, text) in enumerate(docs):
        other = docs[i - 1][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute.order_minhash(text)
        assert r.edited_fingerprint == brute.order_minhash(edited)
        assert r.near_edited == pytest.approx(brute.likeness(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(brute.likeness(r.fingerprint, got[docs[i - 1][0]].fingerprint))
        if 0 < len(text) and text != other:
            near_edited.append(r.near_edited)
            near_next.append(r.near_next)
    # half of the k-mers of both survive the edit, so a pair of picks does with a chance of a quarter
    assert np.mean(near_edited) > 0.2 > 0.05 > np.mean(near_next)
    assert np.mean(np.array(near_edited) > np.array(near_next)) > 0.97


def test_token_files(spark, sf, docs):
    ids = brute.token_ids([t for _, t in docs])
    got = {r.doc_id: r for r in found("op9_token_files", spark, sf)}
    start = 0
    for (d, _), x in zip(docs, ids):
        whole = np.append(x, np.uint32(1)).astype("<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)


def test_quality(spark, sf, docs):
    from pairwave.llm import quality as q

    got = {r.doc_id: r for r in found("op10_quality", spark, sf)}
    for d, text in docs:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text)
        assert (r.lines_removed, r.kept) == brute.verdict(text, q.BOILERPLATE)[1:]
