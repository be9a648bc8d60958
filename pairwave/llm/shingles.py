"""Near copies by SimHash anchors and MinHash bands, decided by the exact Jaccard similarity of word shingles.

SimHash links of 4 bits, found by the anchors of simhash.py, hold few pairs of texts at the lower end of 0.8 and more (two
sets of similarity s differ in each bit with probability arccos(2s / (1 + s)) / pi, so in 9.7 of 64 bits at 0.8). So the
anchors' links are proposals only, and the sketch of a text has BANDS more keys, each over ROWS minima of its shingles'
hashes, that propose the rest: two texts of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS (0.99993 at
0.8). Both come from one pass over the shingles' hashes. Texts with equal sets of shingles count as one.

In a bucket (the sets with one key) the set that shares most keys with others is compared with all others first, twice, so
a large group of copies becomes one component without its pairs being made. What is then left of a bucket outside the
component of its first centre is compared with all of the bucket: dealt to blocks of about BLOCK sets a side, each with
all its shingles, in which a task counts common shingles exactly and returns one link a set and component. No bucket is
capped, and two sets link only if their similarity reaches the limit.

Defined cases: a null or empty text, or one of white space, has the empty set, and all such are copies of each other; a
text with fewer words than a shingle is one shingle; repeated rows are copies; an empty table gives an empty table; extra
columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, numbered, parts_for
from .simhash import links, majority

BANDS, ROWS = 24, 5
#: About how many sets a side a task compares.
BLOCK = 512
_MIX = np.random.default_rng(448).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.random.default_rng(449).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the runs of words of a text in small letters."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    n = len(tokens) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n))


def keys(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        np.minimum(least, ((found[at : at + 4096, None] ^ _MIX[0]) * _MIX[1]).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, __row, set (a hash of the text's shingles), fp (their SimHash) and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, fps, made = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), []
            for i, text in enumerate(batch.column(2)):
                found = shingles(text.as_py(), words)
                sets[i] = np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)
                fps[i] = majority(found) if len(found) else 0
                made.append(keys(found).view(np.int64) if len(found) else [])
            columns = [*batch.columns[:2], pa.array(sets), pa.array(fps.view(np.int64)), pa.array(made, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "__row", "set", "fp", "keys"])

    more = [T.StructField("set", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return rows.select("doc_id", "__row", "text").mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["__row"], *more]))


def _contents(texts: DataFrame, words: int) -> DataFrame:
    """set and all its shingles, of texts (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["set", "shingles"])

    return texts.select("set", "text").mapInArrow(run, "set long, shingles array<long>")


def _similar(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) of sets whose Jaccard similarity is least or more; both frames are materialised."""
    met = pairs.join(held.select(F.col("set").alias("v"), F.col("shingles").alias("b")), "v").join(held.select(F.col("set").alias("u"), F.col("shingles").alias("a")), "u")
    # most pairs of very unequal sizes need no look at their shingles
    met = met.where(F.least(F.size("a"), F.size("b")) >= least * F.greatest(F.size("a"), F.size("b")))
    both = F.size(F.array_intersect("a", "b"))
    return met.where(both >= least * (F.size("a") + F.size("b") - both)).select("u", "v")


def similar_in_block(x: list[np.ndarray], y: list[np.ndarray], of_x: np.ndarray, of_y: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(place in x, place in y) of similar sets of shingles: for each of x one of each other component that it meets."""
    flat = np.concatenate(y)
    sizes = np.fromiter(map(len, y), np.int64, len(y))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = []
    for i, own in enumerate(x):
        n = len(own)
        fits = (np.minimum(sizes, n) >= least * np.maximum(sizes, n)) & (of_y != of_x[i])
        if not fits.any():
            continue
        at = np.searchsorted(own, flat)
        both = np.add.reduceat((own[np.minimum(at, n - 1)] == flat).astype(np.int64), starts)
        hit = np.flatnonzero(fits & (both >= least * (n + sizes - both)))
        out += [(i, int(j)) for j in hit[np.unique(of_y[hit], return_index=True)[1]]]
    return out


def _in_blocks(spans: DataFrame, held: DataFrame, least: float, block: int) -> DataFrame:
    """Links (u, v) between the components in each bucket; spans: key, set, root, of (the root of its centre)."""
    counts = spans.groupBy("key").agg(F.count_if(F.col("root") != F.col("of")).alias("nx"), F.count("*").alias("ny"))
    counts = cut(counts.select("key", *[F.ceil(F.col(n) / block).cast("int").alias(n) for n in ("nx", "ny")]))
    placed = spans.join(counts, "key").join(held, "set")
    deal = lambda n: F.pmod(F.xxhash64("set", "key"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    far = placed.where(F.col("root") != F.col("of")).select("key", deal("nx").alias("x"), all_of("ny").alias("y"), F.lit(True).alias("far"), "set", "root", "shingles")
    every = placed.select("key", all_of("nx").alias("x"), deal("ny").alias("y"), F.lit(False).alias("far"), "set", "root", "shingles")
    dealt = far.union(every).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks stand together; the last one of a batch waits for the next batch."""
        rest: list[tuple] = []

        def compare(rows: list[tuple]) -> tuple[list[int], list[int]]:
            x, y = ([r for r in rows if r[3] is side] for side in (True, False))
            if not x or not y:
                return [], []
            part = lambda rs: ([r[6] for r in rs], np.array([r[5] for r in rs]))
            (sx, ox), (sy, oy) = part(x), part(y)
            found = similar_in_block(sx, sy, ox, oy, least)
            return [x[i][4] for i, _ in found], [y[j][4] for _, j in found]

        def give(rows: list[tuple]) -> pa.RecordBatch:
            u, v = compare(rows)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            plain = [c.to_pylist() for c in batch.columns[:6]]
            column = batch.column(6)
            flat, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            for i, row in enumerate(zip(*plain)):
                if rest and rest[0][:3] != row[:3]:
                    yield give(rest)
                    rest = []
                rest.append((*row, flat[ends[i] : ends[i + 1]].copy()))
        if rest:
            yield give(rest)

    return dealt.mapInArrow(run, "u long, v long")


def _linked(buckets: DataFrame, proposed: DataFrame, held: DataFrame, least: float, block: int, parts: int) -> DataFrame:
    """node, root of the sets in buckets (key, set, weight) or proposed pairs (u, v) that are linked to others."""
    found = cut(_similar(proposed, held, least))
    roots = cut(components(found), parts)
    for turn in range(3):
        spans = buckets.join(roots.withColumnRenamed("node", "set"), "set", "left")
        spans = cut(spans.select("key", "set", "weight", F.coalesce("root", "set").alias("root")), parts)
        centre = F.max(F.struct("weight", "set", "root")).alias("x")
        # a bucket within one component has nothing more to give
        one = spans.groupBy("key").agg(centre, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        one = cut(one.select("key", F.col("x.set").alias("first"), F.col("x.root").alias("of")), parts)
        if one.isEmpty():
            break
        spans = cut(spans.join(one, "key"), parts)
        if turn < 2:
            pairs = spans.where("root <> of").select(F.col("first").alias("u"), F.col("set").alias("v"))
            more = cut(_similar(cut(pairs.distinct(), parts), held, least))
            # the second centre is one that the first did not reach, if there is any
            buckets = spans.where("set <> first").select("key", "set", F.when(F.col("root") != F.col("of"), F.col("weight") + (1 << 40)).otherwise(F.col("weight")).alias("weight"))
        else:
            more = cut(_in_blocks(spans, held, least, block))
        found = found.union(more)
        roots = cut(components(found), parts)
    return roots


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """One row of docs for each group linked by similarities of least or more: of its smallest doc_id the first as read.

    The rows of docs are numbered in partitions fixed at the call, so docs must give each partition alike every time.
    """
    rows = numbered(docs)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    sets = cut(_sketches(rows, words).groupBy("set").agg(F.min(first).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = sets.select(F.explode("keys").alias("key"), "set")
    # written, so that both sides of the join are plain shuffles and the partition of a common key can be split
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = cut(keyed.join(shared, "key"))
    parts = parts_for(buckets, buckets.count())
    buckets = buckets.coalesce(parts)
    weights = cut(buckets.groupBy("set").agg(F.sum("n").alias("weight")), parts)
    buckets = buckets.drop("n").join(weights, "set")
    # anchors join fingerprints; a fingerprint stands for its least set, the others are linked to that one
    full = sets.where(F.size("keys") > 0).select("fp", "set")
    least_of = cut(full.groupBy("fp").agg(F.min("set").alias("least")))
    edges = cut(links(least_of.select("fp")))
    u, v = (least_of.select(F.col("fp").alias(c), F.col("least").alias(n)) for c, n in (("u", "a"), ("v", "b")))
    near = edges.join(u, "u").join(v, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = cut(near.union(full.join(least_of, "fp").where("set <> least").select(F.col("least").alias("u"), F.col("set").alias("v"))).distinct())
    used = buckets.select("set").union(near.select("u")).union(near.select("v")).distinct()
    met = sets.join(used, "set").select("set", F.col("first.__row").alias("__row"))
    held = cut(_contents(rows.select("__row", "text").join(met, "__row"), words))
    roots = _linked(buckets, near, held, least, block, parts)
    rooted = sets.join(roots, F.col("set") == F.col("node"), "left").select("first", F.coalesce("root", "set").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.__row").alias("__row"))
    whole = F.col("doc")
    return rows.join(kept, "__row", "left_semi").select(*[whole[c].alias(c) for c in docs.columns])
