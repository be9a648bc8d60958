"""Repeated line runs: a suffix array over line IDs by prefix doubling, its LCPs, and later copies deleted.

The lines with a word of all documents, in document order, form one sequence (no run spans two documents); equal lines
share an ID. Each suffix that begins with a line of a long enough stretch of repeated lines has a label, one number for each
round: the number of round k names the suffix's first 2^k lines, in their order among those that share the first half.
Labels compare like the suffixes do. A round joins each suffix with the label of the one 2^k lines on, and sorts distinct
pairs only; a suffix leaves when its prefix is its own, or when its group ends at the document's end, so rounds end by
themselves, after the logarithm of the longest repeated run. Sorted labels are the suffix array. The longest common prefix
of two neighbours is read off their labels: they share m numbers, so 2^(m-1) lines, and the rest is that of the suffixes
2^(m-1) lines on. It is only worked out where the pair of one line before isn't the same pair one line up (the others are
one less than that of the line before).

The larger LCP with both neighbours is how far a suffix is repeated anywhere; runs that can't be longer at either end are
the maximal repeated runs. Within those of min_words words or more the later copies are deleted. A line belongs to a later
copy of such a run if and only if it lies in a later copy that is the shortest with min_words from its first line on, or
the shortest up to its last one, and a run of s lines is named by the numbers of the two, overlapping, powers of two that
cover it; so the first place of each run is a grouped minimum. Joins and minima are of narrow rows and combined before
shuffles; neither a common line nor a common run is gathered. Windows hold one document's lines.

Defined cases: "earlier" is by doc_id (nulls first), then the order in which rows are read, then place; a null text stays
null and an empty one empty; lines without a word are never deleted and don't interrupt a run; repeated rows lose what
the first has; an empty table gives an empty table; input columns are passed through, and one named like an output
column (n_lines, removed_lines, removed_runs, whatever the capitals) is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, let, numbered, parts_for, with_order

#: White space, as the inside of a class of characters.
SPACE = r"\x20\x09-\x0D"
#: Bits of a place in the sequence that number the line in its document.
LINE_BITS = 27
#: Words that a run has at least to count as a repeat; a single line may be one.
MIN_WORDS = 5


def _words(line: Column, most: int | None) -> Column:
    """The words of a line; most, if it has more: sums of such counts reach most where sums of the counts do."""
    if most is None:
        return F.regexp_count(line, F.lit(WORD))
    many = f"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{most - 1}}}+[^{SPACE}]"
    return F.when(F.regexp_like(line, F.lit(many)), most).otherwise(F.regexp_count(line, F.lit(WORD)))


def _sequence(rows: DataFrame, most: int | None = None) -> DataFrame:
    """at (place), __row, line (its number in the text), a and b (the line's ID), n (words, see _words), left (lines to the end)."""
    lines = F.transform(
        F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"), _words(x, most).alias("n"))
    )
    full = rows.select("doc_id", "__row", F.filter(lines, lambda x: x["n"] > 0).alias("lines"))
    # written, as the range shuffle reads its input twice; filtered then, as a condition on the lines would make them twice
    placed = with_order(cut(full).where(F.size("lines") > 0), "doc_id", "__row", name="order")
    each = placed.select("order", "__row", F.size("lines").alias("size"), F.posexplode("lines").alias("i", "x"))
    # a longer text would run into the places of the next
    fits = F.when(F.col("size") < (1 << LINE_BITS), F.col("order")).otherwise(F.raise_error(F.lit(f"a text has 2^{LINE_BITS} lines or more")).cast("long"))
    at = F.shiftleft(fits, LINE_BITS) + F.col("i")
    return each.select(at.alias("at"), "__row", "x.line", "x.a", "x.b", "x.n", (F.col("size") - F.col("i")).alias("left"))


def _document() -> Window:
    return Window.partitionBy(F.shiftright("at", LINE_BITS))


def _stretches(lines: DataFrame) -> DataFrame:
    """lines with stretch, the same for lines of a document that stand one after another."""
    return lines.withColumn("stretch", F.col("at") - F.row_number().over(_document().orderBy("at")))


def _long_stretches(lines: DataFrame, min_words: int) -> DataFrame:
    whole = F.sum("n").over(Window.partitionBy(F.shiftright("at", LINE_BITS), "stretch"))
    return _stretches(lines).withColumn("__words", whole).where(F.col("__words") >= min_words).drop("stretch", "__words")


def suffix_labels(seq: DataFrame, min_words: int) -> DataFrame:
    """The suffix array: at, n, left, label, rank of suffixes at lines in stretches of repeated lines with min_words words or more."""
    ids = seq.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b", F.monotonically_increasing_id().alias("id"))
    # groups are written before they are joined, so that both sides are plain shuffles and a common key's partition can be split
    lines = seq.join(cut(ids), ["a", "b"]).select("at", "n", "left", "id")
    active = cut(_long_stretches(lines, min_words).select("at", "n", "left", F.array("id").alias("label"), "id"))
    parts = parts_for(active, active.count())
    active = active.coalesce(parts)
    done, span = active.where("false").drop("id"), 1
    while not active.isEmpty():
        known = done.select("at", "label").union(active.select("at", "label"))
        follow = known.select((F.col("at") - span).alias("at"), F.col("label").alias("next"))
        # lines that are no part of any repeat differ from all others: their place may stand for them
        rest = F.when(F.col("left") <= span, F.array().cast("array<bigint>")).otherwise(F.coalesce("next", F.array(-F.col("at") - span - 1)))
        pairs = active.join(follow, "at", "left").withColumn("next", rest)
        groups = pairs.groupBy("id", "next").agg(F.count("*").alias("c"))
        groups = groups.repartitionByRange("id", "next").sortWithinPartitions("id", "next").withColumn("new", F.monotonically_increasing_id())
        now = pairs.join(cut(groups, parts), ["id", "next"])
        goes = (F.col("c") > 1) & (F.size("next") > 0)
        now = cut(now.select("at", "n", "left", F.concat("label", F.array("new")).alias("label"), F.col("new").alias("id"), goes.alias("goes")), parts)
        done = done.union(now.where("not goes").drop("id", "goes")).coalesce(parts)
        active, span = now.where("goes").drop("goes"), 2 * span
    return cut(with_order(done, "label", "at", name="rank", parts=parts), parts)


def _shared(a: str, b: str) -> Column:
    """How many numbers two labels begin with alike; behind the first that differ, all do."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _power(name: str, more: int = 0) -> Column:
    """2 to the power of the named column plus more, as long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(name) + more)


def neighbours(labels: DataFrame) -> DataFrame:
    """at, before (the suffix before it in the suffix array), lcp; labels are materialised."""
    parts = parts_for(labels, labels.count())
    last = labels.select((F.col("rank") + 1).alias("rank"), F.col("at").alias("before"), F.col("label").alias("other"))
    pairs = labels.join(last, "rank").withColumn("m", _shared("label", "other"))
    # of two whole labels that are equal, both suffixes are
    same = F.when(F.col("label") == F.col("other"), F.col("left"))
    w = _document().orderBy("at")
    goes_on = (F.lag("at").over(w) == F.col("at") - 1) & (F.lag("before").over(w) == F.col("before") - 1) & (F.lag("m").over(w) > 0)
    pairs = pairs.select("at", "before", "m", same.cast("long").alias("same"))
    pairs = cut(pairs.withColumn("head", ~F.coalesce(goes_on, F.lit(False))), parts)
    size = F.when(F.col("m") > 0, _power("m", -1)).otherwise(0)
    heads = pairs.where("head").select("at", "before", F.coalesce("same", size).alias("lcp"), (F.col("same").isNull() & (F.col("m") > 0)).alias("more"))
    own = labels.select(F.col("at").alias("x"), F.col("label").alias("lx"), "left")
    other = labels.select(F.col("at").alias("y"), F.col("label").alias("ly"))
    found, rest = heads.where("not more").drop("more"), cut(heads.where("more").drop("more"), parts)
    while not rest.isEmpty():
        both = rest.withColumn("x", F.col("at") + F.col("lcp")).join(own, "x", "left").withColumn("y", F.col("before") + F.col("lcp")).join(other, "y", "left")
        both = both.withColumn("m", F.coalesce(F.greatest(_shared("lx", "ly"), F.lit(0)), F.lit(0))).withColumn("same", F.coalesce(F.col("lx") == F.col("ly"), F.lit(False)))
        step = F.when(F.col("same"), F.col("left").cast("long")).otherwise(size)
        both = cut(both.select("at", "before", (F.col("lcp") + step).alias("lcp"), ((F.col("m") > 0) & ~F.col("same")).alias("more")), parts)
        found, rest = found.union(both.where("not more").drop("more")).coalesce(parts), both.where("more").drop("more")
    led = pairs.select("at", "before").join(found.select("at", "lcp"), "at", "left")
    head = F.last(F.when(F.col("lcp").isNotNull(), F.col("at") + F.col("lcp")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return cut(led.select("at", "before", (head - F.col("at")).alias("lcp")), parts)


def maximal_runs(seq: DataFrame, labels: DataFrame, min_words: int) -> DataFrame:
    """at, lines, words, other (a place where the run stands too) of the maximal repeated runs of min_words words or more."""
    near, parts = neighbours(labels), parts_for(labels, labels.count())
    both = near.select("at", "lcp", F.col("before").alias("other")).union(near.select(F.col("before").alias("at"), "lcp", F.col("at").alias("other")))
    # the longer of both; its place is that of the earlier neighbour where they are equal
    best = both.where("lcp > 0").groupBy("at").agg(F.max(F.struct("lcp", (-F.col("other")).alias("other"))).alias("x"))
    best = best.select("at", F.col("x.lcp").alias("lines"), (-F.col("x.other")).alias("other"))
    w = _document().orderBy("at")
    inner = (F.lag("at").over(w) == F.col("at") - 1) & (F.lag("lines").over(w) == F.col("lines") + 1)
    heads = best.withColumn("inner", F.coalesce(inner, F.lit(False))).where("not inner").drop("inner")
    sums = cut(labels.select("at", "n").withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))), parts)
    ends = sums.select(F.col("at").alias("end"), F.col("upto").alias("at_end"))
    out = heads.join(sums, "at").withColumn("end", F.col("at") + F.col("lines") - 1).join(ends, "end")
    return cut(out.select("at", "lines", "other", (F.col("at_end") - F.col("upto") + F.col("n")).alias("words")).where(F.col("words") >= min_words), parts)


def _shortest(lines: DataFrame, min_words: int) -> DataFrame:
    """at, size of the shortest runs with min_words words from each line on and up to each line; lines: at, n."""
    w = Window.partitionBy(F.shiftright("at", LINE_BITS), "stretch")
    sums = _stretches(lines).withColumn("end", F.sum("n").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.select("at", "stretch", "end", (F.col("end") - F.col("n")).alias("begin"))

    def met(probe: Column, mark: Column, first: bool) -> DataFrame:
        """at of each line with there, that of the first line whose mark reaches the probe, or the last that it reaches."""
        rows = sums.select("at", "stretch", probe.alias("k"), F.lit(0 if first else 1).alias("side"), F.lit(None).cast("long").alias("there"))
        rows = rows.union(sums.select("at", "stretch", mark.alias("k"), F.lit(1 if first else 0).alias("side"), F.col("at").alias("there")))
        # the first from here on is the last so far in the opposite order, which takes one pass
        o = w.orderBy(*[F.desc(c) if first else F.asc(c) for c in ("k", "side", "at")]).rowsBetween(Window.unboundedPreceding, 0)
        seen = F.last("there", True).over(o)
        return rows.select("at", "side", seen.alias("there")).where(F.col("side") == (0 if first else 1)).where("there is not null")

    down = met(F.col("begin") + min_words, F.col("end"), True).select("at", (F.col("there") - F.col("at") + 1).alias("size"))
    up = met(F.col("end") - min_words, F.col("begin"), False).select(F.col("there").alias("at"), (F.col("at") - F.col("there") + 1).alias("size"))
    return down.union(up).distinct()


def later_copies(labels: DataFrame, runs: DataFrame, min_words: int) -> DataFrame:
    """at of every line in a later copy of a run of min_words words; runs: at, lines of the maximal ones."""
    inside = runs.select(F.explode(F.sequence(F.col("at"), F.col("at") + F.col("lines") - 1)).alias("at")).distinct()
    parts = parts_for(labels, labels.count())
    short = _shortest(cut(labels.select("at", "n").join(inside, "at"), parts), min_words)
    power = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    short = short.withColumn("k", power).withColumn("tail", F.col("at") + F.col("size") - _power("k"))
    x = labels.select("at", F.col("label").alias("x"))
    y = labels.select(F.col("at").alias("tail"), F.col("label").alias("y"))
    named = short.join(x, "at").join(y, "tail").select("at", "size", F.get("x", F.col("k")).alias("x"), F.get("y", F.col("k")).alias("y"))
    named = cut(named.where("x is not null and y is not null"), parts)
    first = named.groupBy("size", "x", "y").agg(F.count("*").alias("c"), F.min("at").alias("first")).where("c > 1").drop("c")
    later = named.join(cut(first, parts), ["size", "x", "y"]).where("at > first")
    return later.select(F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("at")).distinct()


def _without(text: Column, gone: Column) -> Column:
    """text without the lines whose numbers stand in gone (sorted)."""

    def stretch(lines: Column, gone: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        return F.slice(lines, start + 1, F.coalesce(F.get(gone, i), F.size(lines)) - start)

    pieces = let(F.struct(F.split(text, "\n").alias("t"), gone.alias("g")), lambda v: F.transform(F.sequence(F.lit(0), F.size(v["g"])), lambda i: stretch(v["t"], v["g"], i)))
    return F.array_join(F.flatten(pieces), "\n")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The maximal repeated runs: doc_id, start (line number in the text), lines (with a word), words, other_doc_id, other_start.

    A row for each copy; other is a neighbouring copy in the suffix array.
    """
    rows = numbered(docs)
    seq = cut(_sequence(rows))
    labels = suffix_labels(seq, min_words)
    runs = maximal_runs(seq, labels, min_words)
    place = seq.select("at", "__row", "line").join(rows.select("__row", "doc_id"), "__row")
    own = place.select("at", "doc_id", F.col("line").alias("start"))
    other = place.select(F.col("at").alias("other"), F.col("doc_id").alias("other_doc_id"), F.col("line").alias("other_start"))
    return runs.join(own, "at").join(other, "other").select("doc_id", "start", "lines", "words", "other_doc_id", "other_start")


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text without later copies of line runs; n_lines, removed_lines (long) and removed_runs.

    removed_runs: (start, lines) of each stretch of deleted lines, by line number in the given text. The rows
    of docs are numbered in partitions fixed at the call, so docs must give each partition alike every time.
    """
    rows = numbered(docs)
    seq = cut(_sequence(rows, min_words))
    labels = suffix_labels(seq, min_words)
    runs = maximal_runs(seq, labels, min_words)
    later = later_copies(labels, runs, min_words)
    gone = seq.join(later, "at").groupBy("__row").agg(F.sort_array(F.collect_list("line")).alias("__gone"))
    joined = rows.join(gone, "__row", "left")
    joined = joined.withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    first = F.filter(F.transform("__gone", lambda x, i: i), lambda i: (i == 0) | (F.get("__gone", i - 1) + 1 != F.get("__gone", i)))
    end = F.size("__gone")
    stretches = let(first, lambda f: F.transform(f, lambda s, j: F.struct(F.get("__gone", s).alias("start"), (F.coalesce(F.get(f, j + 1), end) - s).alias("lines"))))
    text = F.when(F.size("__gone") == 0, F.col("text")).otherwise(_without(F.col("text"), F.col("__gone")))
    whole = F.col("doc")
    made = {"n_lines": F.size(F.split("text", "\n")).cast("long"), "removed_lines": F.size("__gone").cast("long"), "removed_runs": stretches}
    passed = [c for c in docs.columns if c.lower() not in made]
    return joined.select(*[text.alias(c) if c == "text" else whole[c].alias(c) for c in passed], *[v.alias(k) for k, v in made.items()])
