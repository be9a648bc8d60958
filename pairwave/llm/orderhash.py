"""Order MinHash fingerprints, sensitive to edit distance: minimal occurrence-numbered k-mers, tuples in text order.

The k-mers of a text are its words with the word that follows (the last word stands alone). Equal k-mers are numbered by
occurrence, so repeats count. Each (k-mer, number) has one hash, whose highest bits deal it to one of SLOTS slots; in each
slot the PICKS smallest are selected, put back into text order and hashed as a tuple. Two texts agree in a slot if the
same minimal k-mers stand there in the same order. (This takes one hash function and a slot a sketch, as in one-permutation
hashing, rather than one function a sketch.) Everything is array functions over one row, on longs that hold a hash above
and a position below, so that primitive sorts do the grouping.

Defined cases: words are separated by the six ASCII white-space characters; a null or empty text, or one without words, has
no slot filled and the empty fingerprint; two such are alike (1.0); short texts leave slots empty, and likeness counts the
slots that either fills; repeated rows have equal fingerprints, and "next" among rows with equal doc_id follows the order
in which they are read; a single row is its own next; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let, numbered, with_order

SLOT_BITS, PICKS = 5, 2
#: Low bits that hold a word's position.
PLACE = 28
LOW = (1 << PLACE) - 1
#: Bits of a slot's tuple hash.
HASH_BITS = 32 - SLOT_BITS


def signature(text: Column) -> Column:
    """array<bigint>: for each filled slot, in order, 5 bits of slot above 27 bits of tuple hash."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def kmers(ws: Column) -> Column:
        return F.sort_array(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1)).bitwiseAND(~LOW).bitwiseOR(i.cast("long"))))

    def numbered(u: Column) -> Column:
        """(k-mer, occurrence) hashes above positions, sorted; equal k-mers are neighbours in u, in text order."""
        starts = F.filter(F.transform(u, lambda x, j: j), lambda j: (j == 0) | (F.shiftright(F.get(u, j), PLACE) != F.shiftright(F.get(u, j - 1), PLACE)))

        def run(s: Column, r: Column, all_starts: Column) -> Column:
            equal = F.slice(u, s + 1, F.coalesce(F.get(all_starts, r + 1), F.size(u)) - s)
            return F.transform(equal, lambda x, o: F.xxhash64(F.shiftright(x, PLACE), o).bitwiseAND(~LOW).bitwiseOR(x.bitwiseAND(LOW)))

        return F.sort_array(F.flatten(let(starts, lambda st: F.transform(st, lambda s, r: run(s, r, st)))))

    slot = lambda x: F.shiftright(x, 64 - SLOT_BITS)

    def picked(v: Column) -> Column:
        return F.filter(v, lambda x, j: (j < PICKS) | (slot(F.get(v, j - PICKS)) != slot(x)))

    def tuples(p: Column) -> Column:
        """One hash a slot, of its picks in text order; p is sorted, so a slot's picks are neighbours."""
        firsts = F.filter(F.transform(p, lambda x, j: j), lambda j: (j == 0) | (slot(F.get(p, j - 1)) != slot(F.get(p, j))))

        def one(j: Column) -> Column:
            mine = F.filter(F.slice(p, j + 1, PICKS), lambda x: slot(x) == slot(F.get(p, j)))
            placed = F.sort_array(F.transform(mine, lambda x: F.struct(x.bitwiseAND(LOW).alias("place"), F.shiftright(x, PLACE).alias("kmer"))))
            hashed = F.xxhash64(F.transform(placed, lambda x: x["kmer"]))
            return F.shiftleft(slot(F.get(p, j)) + (1 << (SLOT_BITS - 1)), HASH_BITS).bitwiseOR(hashed.bitwiseAND((1 << HASH_BITS) - 1))

        return F.transform(firsts, one)

    return let(words, lambda ws: let(kmers(ws), lambda u: let(numbered(u), lambda v: let(picked(v), tuples))))


def as_text(sig: Column) -> Column:
    """8 hex digits for each filled slot."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Of the slots that either signature fills, the share in which both agree."""
    slots = lambda s: F.transform(s, lambda x: F.shiftright(x, HASH_BITS))
    either = F.size(F.array_union(slots(a), slots(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(either, F.lit(0)))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is taken from the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document is the one
    before in ascending doc_id, for the first the last. Texts travel once, keyed by row, and their first parts once.
    """
    rows = numbered(docs.select("doc_id", "text")).select(F.col("__row").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = checkpoint(rows.select("row", "doc_id", F.length("text").cast("long").alias("n_chars"), signature(F.col("text")).alias("sig")))
    placed = checkpoint(with_order(own.select("row", "doc_id", "n_chars"), "doc_id", "row", name="at"))
    total = placed.count()
    after = placed.select(((F.col("at") + 1) % max(1, total)).alias("at"), F.col("row").alias("next"))
    pairs = placed.join(after, "at").select(F.col("row").alias("own"), "next", F.floor(F.col("n_chars") / 3).cast("int").alias("cut"))
    texts = rows.select("row", "text")
    # the two joins take the same exchange of texts by row, so it is made once
    starts = texts.join(pairs, F.col("row") == F.col("next")).select("own", "next", "cut", F.substring("text", F.lit(1), F.col("cut")).alias("start"))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("cut")), F.col("start"))
    made = let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), signature(e).alias("sig")))
    both = texts.join(starts, F.col("row") == F.col("own")).select("row", "next", made.alias("edited"))
    both = both.join(own, "row").join(own.select(F.col("row").alias("next"), F.col("sig").alias("next_sig")), "next")
    return both.select(
        "doc_id",
        "n_chars",
        F.col("edited.sha").alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited.sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited.sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
