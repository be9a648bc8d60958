"""Spelling variants: words one edit apart, each with its most frequent neighbour as form, and the end of the forms as root.

Near words are found by a positional q-gram index with a count filter. An edit of one code point destroys at most q grams,
so two near words share max(length) - 2q + 1 of them, those behind the edit shifted by the difference of the lengths. Hence
they also share one of the q + 1 grams of each that are the rarest of all words (same order for all words, so a gram that
both keep can't be late in one and early in the other), at the same place if they are equally long, else at the same or the
next place of the longer one. The index is dealt by (gram, place, length) of these rare grams: a word is entered under its
own length and probes the next one. A task takes the entries of a key together, builds posting lists of all their grams by
place, merges the lists that a probe's grams name (runs sorted by entry, merged by NumPy's stable sort, many probes at a
time, a bounded number of postings at once), keeps entries met as often as the bound says, and compares the words.

A key of more than BLOCK entries is cut into blocks by a hash of the word; its probes go to each block, so no task holds more
than a block of entries with its index, and nothing is left out. Counts, keys and pairs are combined before shuffles.
A word has at most (alphabet * length) near words, which bounds what is gathered for it. Forms are at least ratio times as
frequent as their words, so chains of forms are shorter than the logarithm of the largest count; roots come from doubling
jumps along them.

Defined cases: a null text has no words; a null or too short word is dropped before the index; repeated documents count
each; two words that are one swap of neighbours apart are two edits apart, so not near; of near words with equal counts the
first by code points is the form; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Code points of a gram.
GRAM = 3
#: Entries of a key that a task indexes at once.
BLOCK = 4096
#: Postings that are merged at once.
MERGED = 2_000_000
#: Grams, and keys of several blocks, that are broadcast at most.
MOST_ROWS = 1_000_000
#: What an entry does: it is found, it probes, or both.
FOUND, PROBES, BOTH = 0, 1, 2


def count_words(words: DataFrame, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """word, n of the column word, of words with enough code points and occurrences."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_ROWS else df


def _entries(words: DataFrame) -> DataFrame:
    """k (a number of gram, place, length and block), size (length of what is found), kind, word, n."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda i: F.substring("word", i, F.lit(GRAM)))
    each = words.select("word", "n", F.posexplode(grams).alias("place", "gram"))
    often = cut(each.groupBy("gram").agg(F.count("*").alias("c")))
    rare = each.join(_broadcast_if_small(often), "gram").groupBy("word", "n").agg(F.collect_list(F.struct("c", "gram", "place")).alias("g"))
    rare = rare.select("word", "n", F.explode(F.slice(F.array_sort("g"), 1, GRAM + 1)).alias("g")).select("word", "n", "g.gram", "g.place")
    size = F.length("word")

    def key(kind: int, more: int, shift: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (size + more).alias("size"), F.xxhash64("gram", F.col("place") + shift, size + more).alias("k"))

    rows = rare.select("word", "n", F.explode(F.array(key(BOTH, 0, 0), key(PROBES, 1, 0), key(PROBES, 1, 1))).alias("x")).select("word", "n", "x.*")
    full = rows.where(F.col("kind") == BOTH).groupBy("k").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    rows = rows.join(_broadcast_if_small(cut(full)), "k", "left")
    all_blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(PROBES).alias("kind")))
    own = F.struct(F.pmod(F.xxhash64("word"), F.col("blocks")).alias("block"), F.lit(FOUND).alias("kind"))
    dealt = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("block"), F.col("kind")))).when(F.col("kind") == PROBES, all_blocks).otherwise(F.concat(F.array(own), all_blocks))
    rows = rows.select("word", "n", "size", "k", F.explode(dealt).alias("x"))
    return rows.select(F.xxhash64("k", "x.block").alias("k"), "size", "x.kind", "word", "n")


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from low to high (not included) of each, one after another, and which one each belongs to."""
    many = high - low
    owner = np.repeat(np.arange(len(low)), many)
    return np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + low[owner], owner


def _near(group: np.ndarray, kind: np.ndarray, length: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (probe, entry) of near pairs; points: a row a word, all found ones as long as a row, others one shorter."""
    size, least = points.shape[1], points.shape[1] - 2 * GRAM + 1
    places = size - GRAM + 1
    wide = points.astype(np.int64)
    code = sum(wide[:, i : i + places] << 21 * i for i in range(GRAM))
    _, code = np.unique(code, return_inverse=True)
    span = int(code.max()) + 1
    width = span * places
    code = code.reshape(-1, places) + span * np.arange(places)  # a gram at a place
    same = np.nonzero(kind != PROBES)[0]
    keys = (group[same, None] * width + code[same]).ravel()
    order = np.argsort(keys, kind="stable")
    keys, entry = keys[order], same[order // places]
    found = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    for shorter in (False, True):
        probe = np.nonzero((kind != FOUND) & ((length < size) == shorter))[0]
        if not len(probe):
            continue
        mine = code[probe, : places - 1] if shorter else code[probe]
        names = group[probe, None] * width + mine
        if shorter:
            names = np.hstack([names, names + span])  # the same gram one place on
        who = np.repeat(probe, names.shape[1])
        low, high = (np.searchsorted(keys, names.ravel(), side) for side in ("left", "right"))
        # whole probes at a time, of a bounded number of postings
        ends = np.cumsum(high - low)[names.shape[1] - 1 :: names.shape[1]]
        at = 0
        while at < len(probe):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + MERGED, "right")))
            part = slice(at * names.shape[1], to * names.shape[1])
            post, owner = _ranges(low[part], high[part])
            left, right = who[part][owner], entry[post]
            if not shorter:  # each pair of equal length once
                keep = (left < right) | (kind[left] == PROBES)
                left, right = left[keep], right[keep]
            pairs, times = np.unique(np.sort(left * len(kind) + right, kind="stable"), return_counts=True)
            pairs = pairs[times >= least]
            left, right = pairs // len(kind), pairs % len(kind)
            a, b = points[left], points[right]
            if shorter:
                a = a[:, :-1]
                front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
                back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                good = front + back >= size - 1
            else:
                good = (a != b).sum(axis=1) == 1
            found[0].append(left[good])
            found[1].append(right[good])
            at = to
    return np.concatenate(found[0]), np.concatenate(found[1])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, a_n, b, b_n of near words; the rows of a key stand together, keys by size."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes, k, kind = (rows.column(c).to_numpy() for c in ("size", "k", "kind"))
        names, counts = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
        for size in np.unique(sizes):
            at = np.nonzero(sizes == size)[0]
            own = names.take(pa.array(at))
            points = np.array(own.to_pylist(), f"U{size}").view(np.uint32).reshape(len(at), size)
            group = np.unique(k[at], return_inverse=True)[1]
            left, right = (pa.array(at[x]) for x in _near(group, kind[at], (points > 0).sum(axis=1), points))
            if len(left):
                yield pa.RecordBatch.from_arrays([names.take(left), counts.take(left), names.take(right), counts.take(right)], ["a", "a_n", "b", "b_n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 2 * BLOCK:
            rows = pa.Table.from_batches(held)
            k = rows.column("k").to_numpy()
            ends = np.nonzero(k[1:] != k[:-1])[0] + 1
            if len(ends):  # the last key may go on
                yield from pairs(rows.slice(0, ends[-1]))
                held = rows.slice(ends[-1]).to_batches()
    if held:
        yield from pairs(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: pairs of words (word, n; distinct, of 2 * GRAM code points at least) one edit apart; a pair may come
    several times, once for each rare gram that both have."""
    rows = _entries(words.where(F.length("word") >= 2 * GRAM))
    rows = rows.repartition("k").sortWithinPartitions("size", "k").select("k", "size", "kind", "word", "n")
    return rows.mapInArrow(_merge, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words that have a form: follows forms to the last one, by jumps that double."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root of distinct words with their counts n.

    form: the near word with the largest count, the first of equals, if it is ratio times the word's or more, else null.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = near_words(words)
    other = lambda x, y: F.struct(F.col(x).alias("word"), (-F.col(f"{y}_n")).alias("less"), F.col(y).alias("near"))
    each = pairs.select(F.explode(F.array(other("a", "b"), other("b", "a"))).alias("x")).select("x.*")
    near = each.groupBy("word").agg(F.collect_set(F.struct("less", "near")).alias("near"))
    near = near.select("word", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("best"))
    out = words.join(near, "word", "left")
    good = -F.col("best.less") >= ratio * F.col("n")
    out = cut(out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")))
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
