"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into three parts of 21, 21 and 22 bits. If two fingerprints differ in at most 4 bits, some
part differs in at most one. The anchors of a part are the 4096 words of the perfect binary Golay code (23 bits, covering
radius 3; parts are padded with zeros). A fingerprint has one home anchor a part, within 3 bits, and is replicated to
every anchor within 3 + 1 bits (about five); of two fingerprints whose part differs in one bit or none, each is within
4 bits of the other's home. So comparing, per anchor, the fingerprints at home with those replicated there finds every
link. Only distinct fingerprints are compared, and an anchor with many is dealt out in blocks of at most BLOCK rows a
side, so no task gathers an unbounded group. A block returns a spanning forest of its links, never all pairs.

Defined cases: a null or empty text, or one of white space, has fingerprint 0 and links like any other; a text with
fewer words than a shingle is one shingle; repeated rows share a fingerprint and a component; rows with a null doc_id
take part, and a component with no other row has a null id; an empty table gives an empty table; other columns of the
input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, components, numbered

BITS, SLACK = 4, 1
PARTS = ((0, 21), (21, 21), (42, 22))
#: Most rows a side in one comparison.
BLOCK = 1024
# Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY, LENGTH, CHECK, RADIUS = 0b110001110101, 23, 11, 3


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned SimHash of a whole text over its word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - k + 1
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashes (uint64): the bits set in more than half of them."""
    n, set_in = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        block = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The id columns and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(len(ids))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], pa.array(made.view(np.int64))], [*ids, "fp"])

    schema = T.StructType([*(docs.schema[c] for c in ids), T.StructField("fp", T.LongType())])
    return docs.select(*ids, "text").mapInArrow(run, schema)


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Remainders by the generator."""
    x = x.astype(np.int64).copy()
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        x ^= ((x >> bit) & 1) * (GOLAY << (bit - CHECK))
    return x


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: all difference words up to weight RADIUS + SLACK, lightest first, and how many."""
    words = np.arange(1 << LENGTH, dtype=np.int64)
    weight = np.bitwise_count(words)
    light = words[weight <= RADIUS + SLACK]
    light = light[np.argsort(np.bitwise_count(light), kind="stable")]
    found = _syndromes(light)
    counts = np.bincount(found, minlength=1 << CHECK)
    out = np.zeros((1 << CHECK, counts.max()), np.int64)
    order = np.argsort(found, kind="stable")
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    column = np.arange(len(light)) - first[found[order]]
    out[found[order], column] = light[order]
    return out, counts


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) for every anchor that the fingerprints are replicated to."""
    table, counts = _TABLE or _TABLE.extend(_patterns()) or _TABLE
    rows, keys, home = [], [], []
    for number, (shift, width) in enumerate(PARTS):
        part = ((fps.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = _syndromes(part)
        for k in range(table.shape[1]):
            has = np.flatnonzero(counts[s] > k)
            rows.append(has)
            keys.append((number << LENGTH) + (part[has] ^ table[s[has], k]))
            home.append(np.full(len(has), k == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


_TABLE: list = []


def linked(home: np.ndarray, near: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sets of fingerprints, as pairs; both are uint64."""
    close = np.bitwise_count(home[:, None] ^ near[None, :]) <= bits
    if close.sum() <= 2 * (len(home) + len(near)):
        a, b = np.nonzero(close)
        a, b = home[a], near[b]
    else:
        top = np.iinfo(np.int64).max
        label = np.arange(len(home))
        while True:
            reached = np.where(close, label[:, None], top).min(axis=0)
            again = np.minimum(label, np.where(close, reached[None, :], top).min(axis=1))
            if (again == label).all():
                break
            label = again
        hit = reached < top
        a = np.concatenate((home, near[hit]))
        b = np.concatenate((home[label], home[reached[hit]]))
    other = a != b
    return a[other], b[other]


def links(distinct: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect whatever lies within 4 bits."""
    if bits > BITS:
        raise ValueError(f"the anchors cover {BITS} differing bits")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key, home = anchors(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(home)], ["anchor", "fp", "home"])

    placed = checkpoint(distinct.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean"))
    # at most 3 * 4096 rows, as many as the code has anchors
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).where("h > 0 and n > 1")
    sizes = sizes.select("anchor", F.ceil(F.col("n") / block).cast("int").alias("nb"), F.ceil(F.col("h") / block).cast("int").alias("hb"))
    placed = placed.join(F.broadcast(sizes), "anchor")
    own = F.pmod(F.xxhash64("fp", "anchor"), F.col("nb")).cast("int")
    near = placed.select("anchor", "fp", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("x"), own.alias("y"))
    own = F.pmod(F.xxhash64("fp", "anchor"), F.col("hb")).cast("int")
    at = placed.where("home").select("anchor", "fp", "home", own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"))
    dealt = near.union(at).repartition("anchor", "x", "y").sortWithinPartitions("anchor", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups stand together; the last one of a batch waits for the next batch."""
        rest: list[np.ndarray] | None = None

        def groups(cols: list[np.ndarray], last: bool):
            key = cols[0]
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (cols[3][1:] != cols[3][:-1]) | (cols[4][1:] != cols[4][:-1])) + 1
            edges = [0, *cuts.tolist(), len(key)]
            us, vs = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                if b == len(key) and not last:
                    break
                fps, home = cols[1][a:b].view(np.uint64), cols[2][a:b]
                if home.any() and not home.all():
                    u, v = linked(fps[home], fps[~home], bits)
                    us.append(u)
                    vs.append(v)
            kept = None if last else [c[edges[-2] :] for c in cols]
            u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))
            return kept, pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
                rest, out = groups(cols, False)
                yield out
        if rest is not None and len(rest[0]):
            yield groups(rest, True)[1]

    return dealt.mapInArrow(compare, "u long, v long")


def classes(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """fps (doc_id, __row, fp; materialised) with first: the (doc_id, __row) that comes first in the row's component."""
    distinct = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"))
    distinct = checkpoint(distinct)
    found = checkpoint(components(links(distinct, bits)))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.drop("first").join(least, "root").select("fp", "first")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of every row."""
    fps = checkpoint(fingerprints(docs.select("doc_id", "text", F.lit(0).cast("long").alias("__row")), words, ("doc_id", "__row")))
    return classes(fps, bits).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """One row of docs for each component: of those with its smallest doc_id the first as docs is read.

    The rows of docs are numbered in partitions fixed at the call, so docs must give each partition alike every time.
    """
    rows = numbered(docs)
    fps = checkpoint(fingerprints(rows, words, ("doc_id", "__row")))
    kept = classes(fps, bits).where(F.col("first.__row") == F.col("__row")).select("__row")
    whole = F.col("doc")
    return rows.join(kept, "__row", "left_semi").select(*[whole[c].alias(c) for c in docs.columns])
