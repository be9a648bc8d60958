"""Benchmark decontamination: a broadcast hash set of test n-grams, windows of all training texts scanned against it.

Words are maximal runs of ASCII letters and digits and of all code points beyond ASCII, with A-Z lower-cased. A benchmark
item's windows are its runs of size consecutive words; an item of fewer words is one window. Windows are hashed from their
words' hashes, so a document makes one number a window; these are looked up in the set of the items' hashes. What is found
is held against the words themselves before it counts, so no hash decides. A hit word lies in any occurrence of a window;
neighbouring hit words are a span, and spans or whole documents go.

All steps are DataFrame functions. The set is broadcast where its rows are at most MOST_GRAMS, else both sides are
shuffled by hash; the found places of documents are broadcast where they take at most MOST_BYTES, else joined to the
documents by a shuffle whose partitions adaptive execution can split. Windows of a document are narrow rows as soon as they
exist; only found ones are gathered, by window first, then by document.

Defined cases: a null text has no words, stays null and is clean; an item without words has no windows; a null item ID
counts as the empty ID, and rows of one item ID are one item; repeated documents are judged each; an empty benchmark leaves
all documents as they are; an empty table gives an empty table; input columns are passed through, and one named like an
output column (n_words, n_hit, items, spans, contaminated, whatever the capitals) is replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, numbered

#: What no word holds: ASCII but letters and digits; behind it, ASCII but small letters and digits.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
BETWEEN_LOWER = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Hashes of windows that are broadcast at most, of 16 bytes each.
MOST_GRAMS = 1_000_000
#: Bytes of found windows that are broadcast at most.
MOST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """The words of a text in order; none of a null text."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(low, F.lit(f"[^{BETWEEN_LOWER}]+"), F.lit(0)), F.array().cast("array<string>"))


def _window_hashes(hashes: Column, size: int) -> Column:
    """A hash of each size consecutive hashes."""
    at = F.sequence(F.lit(1), F.size(hashes) - (size - 1))
    return F.when(F.size(hashes) >= size, F.transform(at, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(size)))))


def _hashed(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def grams(benchmark: DataFrame, size: int) -> DataFrame:
    """gram (words joined by a space), size (its words), h (its hash), items (sorted IDs as strings); one row a window."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(size)))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))
    each = rows.select("item", "size", F.explode(windows).alias("w")).distinct()
    each = each.select("item", "size", F.array_join("w", " ").alias("gram"), F.xxhash64(_hashed(F.col("w"))).alias("h"))
    return each.groupBy("gram", "size", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _small(df: DataFrame, rows: int | None = None, size: Column | None = None) -> DataFrame:
    """df, to be broadcast if it is within the limit."""
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0)).alias("bytes")).first()
    fits = total["n"] <= rows if rows is not None else total["bytes"] <= MOST_BYTES
    return F.broadcast(df) if fits else df


def found_windows(rows: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """__row and found, an array of (gram, size, items, places): windows of known whose hash a document has, and where."""
    # a hash array for each length, each its own row before its windows are
    windows = lambda h: F.array(*[F.struct(F.lit(n).alias("size"), _window_hashes(h, n).alias("h")) for n in lengths])
    arrays = rows.select("__row", F.explode(let(_hashed(words(F.col("text"))), windows)).alias("x")).select("__row", "x.size", "x.h")
    each = arrays.select("__row", "size", F.posexplode("h").alias("place", "h"))
    hits = cut(each.join(_small(known.select("h", "size").distinct(), rows=MOST_GRAMS), ["h", "size"]))
    size = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 8)
    named = hits.join(_small(known, size=size), ["h", "size"])
    places = named.groupBy("__row", "gram", "size", "items").agg(F.collect_list("place").alias("places"))
    return places.groupBy("__row").agg(F.collect_list(F.struct("gram", "size", "items", "places")).alias("found"))


def _verified(text: Column, found: Column) -> Column:
    """found with those places only whose words are the window's."""

    def check(v: Column) -> Column:
        same = lambda g: F.filter(g["places"], lambda p: F.array_join(F.slice(v["w"], p + 1, g["size"]), " ") == g["gram"])
        kept = F.transform(v["f"], lambda g: F.struct(g["size"].alias("size"), g["items"].alias("items"), same(g).alias("places")))
        return F.filter(kept, lambda g: F.size(g["places"]) > 0)

    return let(F.struct(words(text).alias("w"), found.alias("f")), check)


def _spans(hit: Column) -> Column:
    """(start, words) of runs of neighbouring numbers of a sorted array."""
    first = lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i - 1) + 1 != F.get(h, i)))
    ends = lambda v, j: F.coalesce(F.get(v["first"], j + 1), F.size(v["h"]))
    return F.when(F.size(hit) == 0, F.array().cast("array<struct<start:int,words:int>>")).otherwise(
        let(hit, lambda h: let(F.struct(h.alias("h"), first(h).alias("first")), lambda v: F.transform(v["first"], lambda i, j: F.struct(F.get(v["h"], i).alias("start"), (ends(v, j) - i).alias("words")))))
    )


def _without(text: Column, spans: Column) -> Column:
    """text without the spans' words, what stands between them, and what follows each up to the next word."""
    pieces = F.regexp_extract_all(text, F.lit(f"[^{BETWEEN}]+|[{BETWEEN}]+"), F.lit(0))
    first = F.when(F.regexp_like(text, F.lit(f"^[{BETWEEN}]")), 1).otherwise(0)

    def kept(v: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(let(F.get(v["s"], i - 1), lambda s: 2 * (s["start"] + s["words"]) + v["first"]))
        end = F.coalesce(2 * F.get(v["s"], i)["start"] + v["first"], F.size(v["p"]))
        return F.slice(v["p"], start + 1, F.greatest(end - start, F.lit(0)))

    whole = let(F.struct(pieces.alias("p"), spans.alias("s"), first.alias("first")), lambda v: F.transform(F.sequence(F.lit(0), F.size(v["s"])), lambda i: kept(v, i)))
    return F.array_join(F.flatten(whole), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "spans") -> DataFrame:
    """docs with n_words, n_hit (long), items (IDs of items with an occurring window), spans (start and words of hit runs,
    by word number) and contaminated.

    remove: "spans" takes them out of the text, "documents" leaves contaminated documents out, "nothing" only marks.
    """
    if remove not in ("spans", "documents", "nothing"):
        raise ValueError(f"remove must be spans, documents or nothing, not {remove!r}")
    rows, known = numbered(docs), cut(grams(benchmark, size))
    lengths = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most size numbers
    none = F.array().cast("array<struct<size:int,items:array<string>,places:array<int>>>")
    if lengths:
        found = cut(found_windows(rows, known, lengths))
        each = lambda g: F.octet_length(g["gram"]) + 4 * F.size(g["places"]) + F.aggregate(g["items"], F.lit(0), lambda n, x: n + F.octet_length(x) + 8)
        found = _small(found, size=F.aggregate("found", F.lit(0), lambda n, g: n + each(g)))
        rows = rows.join(found, "__row", "left")
        rows = rows.withColumn("__v", F.when(F.col("found").isNotNull(), _verified(F.col("text"), F.col("found"))).otherwise(none))
    else:
        rows = rows.withColumn("__v", none)
    places = F.flatten(F.transform("__v", lambda g: F.flatten(F.transform(g["places"], lambda p: F.sequence(p, p + g["size"] - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("__v", lambda g: g["items"]))))
    clear = F.size("__v") == 0
    hit = F.when(clear, F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(places)))
    rows = rows.select("doc", "text", hit.alias("__hit"), F.when(clear, F.array().cast("array<string>")).otherwise(items).alias("__items"))
    rows = rows.withColumn("__spans", _spans(F.col("__hit")))
    clear = F.size("__hit") == 0
    text = F.when(clear, F.col("text")).otherwise(_without(F.col("text"), F.col("__spans"))) if remove == "spans" else F.col("text")
    made = {
        "n_words": F.size(words(F.col("text"))).cast("long"),
        "n_hit": F.size("__hit").cast("long"),
        "items": F.col("__items"),
        "spans": F.col("__spans"),
        "contaminated": ~clear,
    }
    if remove == "documents":
        rows = rows.where(F.size("__hit") == 0)
    whole = F.col("doc")
    passed = [c for c in docs.columns if c.lower() not in made]
    return rows.select(*[text.alias(c) if c.lower() == "text" else whole[c].alias(c) for c in passed], *[v.alias(k) for k, v in made.items()])
