"""Conversation repair: the cheapest edits that make the turns of a conversation follow a grammar of roles.

The edits of a conversation are paths of a weighted automaton: in a state of the grammar a row may be kept, given another
role, or deleted, and turns without text may be inserted before it, each at a cost. This automaton is made deterministic
lazily, from the last row to the first: what the rest of a conversation costs from each state, less the least of these, is a
state of the deterministic one, and its moves, one for each kind of row, are worked out when first met and kept in a table.
So costs come from one table look-up a row. The audit is then traced against the direction of the scan, from the first row
on along tight arcs, those whose cost and rest add up to the cost here; of several the one of the least letter, so that of all
cheapest audits the least string is found. Arcs taken are kept in a table too.

Conversations are dealt in pieces of SPAN turns, so a conversation of any length is no single task. The rest's costs at the
end of a piece depend on the pieces behind it, and its first state on those before: for pieces of longer conversations a
first pass gives the cost from each state to each, and which of these ways is the least string, a few numbers a piece. These
are chained for each conversation, and the second pass traces each piece between the states that it got.

Rows: (conv_id, turn, role, text). A row's first fault counts: blank (no character but white space), duplicate (its role and
text stand earlier), truncated (its last such character is no end of a sentence). Blank and duplicate rows are deleted.

Defined cases: rows stand by turn (nulls first), then role, text, and any order for equal rows; null roles and texts count as
the empty string (callers put in what they want); null conv_ids are one conversation; roles are told by their first
character, and a role that the grammar doesn't know can be changed or deleted only; a conversation without rows has no
result; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pinned

#: Turns of a piece.
SPAN = 512
SOLID = r"[^\x20\x09-\x0D]"
#: More than any way through a conversation costs, and less than what a sum of two overflows.
NEVER = 1 << 60


@dataclass(frozen=True)
class Grammar:
    """moves: (state, first character of a role) to state; the first state is start; inserted: roles that edits may give."""

    start: str = "start"
    ends: frozenset[str] = frozenset({"start", "assistant"})
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "s"): "system",
            ("start", "u"): "user",
            ("system", "u"): "user",
            ("user", "a"): "assistant",
            ("assistant", "u"): "user",
        }
    )
    given: tuple[str, ...] = ("assistant", "user")
    #: pairs of first characters that may stand next to each other
    follow: tuple[str, ...] = ("su", "ua", "au")
    keep: int = 0
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1

    @property
    def states(self) -> list[str]:
        return sorted({self.start} | {q for q, _ in self.moves} | set(self.moves.values()))


class Tables:
    """The deterministic automaton as far as it was met. Vectors are numbered; a vector is the rest's cost from each state."""

    def __init__(self, grammar: Grammar):
        self.g, self.q = grammar, grammar.states
        place = {q: i for i, q in enumerate(self.q)}
        self.moves = [{c: place[to] for (q, c), to in grammar.moves.items() if q == state} for state in self.q]
        self.start, self.ends = place[grammar.start], [place[q] for q in sorted(grammar.ends)]
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple, tuple[int, int]] = {}
        self.arcs: dict[tuple, tuple[tuple[tuple[str, str | None], ...], int]] = {}

    def vector(self, costs: list[int]) -> tuple[int, int]:
        """The number of costs less their least, and that least."""
        low = min(costs)
        v = tuple(c - low if c < NEVER else NEVER for c in costs)
        if v not in self.numbers:
            self.numbers[v] = len(self.vectors)
            self.vectors.append(v)
        return self.numbers[v], low

    def closed(self, costs: list[int]) -> list[int]:
        """The costs if turns may be inserted first."""
        for _ in self.q:
            costs = [min([c, *(self.g.insert + costs[m[r[0]]] for r in self.g.given if r[0] in m)]) for c, m in zip(costs, self.moves)]
        return costs

    def end(self) -> list[int]:
        """The costs behind the last row."""
        return self.closed([0 if i in self.ends else NEVER for i in range(len(self.q))])

    def _edits(self, row: tuple, q: int) -> list[tuple[str, str | None, int, int]]:
        """(letter, role given, cost, next state) of the edits of a row; row: (must go, first character, truncated)."""
        must_go, first, short = row
        out = [("D", None, self.g.delete, q)]
        if not must_go:
            more = self.g.truncated if short else 0
            if first in self.moves[q]:
                out.append(("K", None, self.g.keep + more, self.moves[q][first]))
            out += [("R", r, self.g.rerole + more, self.moves[q][r[0]]) for r in self.g.given if r[0] in self.moves[q]]
        return out

    def step(self, after: int, row: tuple) -> tuple[int, int]:
        """The vector before a row, and what its least is above that of the vector after it."""
        key = (after, row)
        if key not in self.steps:
            v = self.vectors[after]
            costs = [min(c + v[to] for _, _, c, to in self._edits(row, q)) for q in range(len(self.q))]
            self.steps[key] = self.vector(self.closed([min(c, NEVER) for c in costs]))
        return self.steps[key]

    def arc(self, after: int, row: tuple, q: int) -> tuple[tuple[tuple[str, str | None], ...], int]:
        """The edits of least letters from state q over a row, and the state behind it."""
        key = (after, row, q)
        if key not in self.arcs:
            before, more = self.step(after, row)
            v, w, edits, at = self.vectors[after], self.vectors[before], [], q
            while True:
                tight = [(letter, r or "", to) for letter, r, c, to in self._edits(row, at) if c + v[to] == w[at] + more]
                tight += [("I", r, self.moves[at][r[0]]) for r in self.g.given if r[0] in self.moves[at] and self.g.insert + w[self.moves[at][r[0]]] == w[at]]
                letter, r, at = min(tight)
                edits.append((letter, r or None))
                if letter != "I":
                    break
            self.arcs[key] = tuple(edits), at
        return self.arcs[key]

    def tail(self, q: int) -> tuple[tuple[tuple[str, str | None], ...], int]:
        """The turns inserted behind the last row from state q, and their cost."""
        costs, edits = self.end(), []
        total = costs[q]
        while not (costs[q] == 0 and q in self.ends):
            r = min(r for r in self.g.given if r[0] in self.moves[q] and self.g.insert + costs[self.moves[q][r[0]]] == costs[q])
            edits.append(("I", r))
            q = self.moves[q][r[0]]
        return tuple(edits), total

    def scan(self, rows: list[tuple], end: list[int]) -> tuple[list[int], list[int]]:
        """The vector behind each row, by the table, and the costs before the first."""
        number, cost = self.vector(end)
        after = [0] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            after[i] = number
            number, more = self.step(number, rows[i])
            cost += more
        return after, [min(NEVER, c + cost) for c in self.vectors[number]]

    def trace(self, rows: list[tuple], after: list[int], q: int) -> tuple[list[tuple], int]:
        """The edits of each row from state q on, and the last state."""
        out = []
        for row, number in zip(rows, after):
            edits, q = self.arc(number, row, q)
            out.append(edits)
        return out, q


def faulty(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (blank, duplicate, truncated or null), piece and row (unique) of each row."""
    full = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = pinned(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *full)).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("blank", ~F.regexp_like("text", F.lit(SOLID))).withColumn("same", F.sha2("text", 256))
    rows = rows.withColumn("place", F.struct(F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62))).cast("long").alias("piece"), "turn", "row"))
    often = rows.where("not blank").groupBy("conv_id", "role", "same").agg(F.count("*").alias("c"), F.min("place").alias("first")).where("c > 1")
    often = often.select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("same").alias("__s"), "first")
    rows = rows.join(often, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("same") == F.col("__s")), "left")
    solid = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.substring(solid, -1, 1).isin(*".!?"), "truncated")
    return rows.select("conv_id", F.col("place.piece").alias("piece"), "turn", "role", "text", "row", fault.alias("fault"))


def _kinds(fault: list, role: list) -> list[tuple]:
    return [(f in ("blank", "duplicate"), r[:1], f == "truncated") for f, r in zip(fault, role)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (conv_id, piece); rows stand in that order."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        keys = list(zip(rows.column("conv_id").to_pylist(), rows.column("piece").to_pylist()))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            part = rows.slice(a, b - a)
            if held and (held[-1].column("conv_id")[0].as_py(), held[-1].column("piece")[0].as_py()) != keys[a]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _ways(grammar: Grammar):
    """A pass over the pieces of longer conversations: costs and ranks from each state to each, first and last characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(grammar)
        n = len(t.q)
        for rows in _pieces(batches):
            roles = rows.column("role").to_pylist()
            kinds = _kinds(rows.column("fault").to_pylist(), roles)
            costs, texts = [[NEVER] * n for _ in range(n)], [[""] * n for _ in range(n)]
            for to in range(n):
                after, before = t.scan(kinds, [0 if i == to else NEVER for i in range(n)])
                for q in range(n):
                    costs[q][to] = before[q]
                    if before[q] < NEVER:
                        texts[q][to] = "".join(letter for edits in t.trace(kinds, after, q)[0] for letter, _ in edits)
            # one order of all ways from a state
            ranks = [sorted(set(x)).index(w) for x in texts for w in x]
            yield pa.RecordBatch.from_pydict(
                {"conv_id": rows.column("conv_id").slice(0, 1).combine_chunks(), "piece": rows.column("piece").slice(0, 1).combine_chunks(), "costs": pa.array([sum(costs, [])], pa.list_(pa.int64())), "ranks": pa.array([ranks], pa.list_(pa.int64())), "last": [roles[-1][:1]]}
            )

    return run


def _chain(grammar: Grammar):
    """The first state and the costs behind each piece of a conversation, from the ways through its pieces."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        t = Tables(grammar)
        n, group = len(t.q), group.sort_values("piece", ignore_index=True)
        ends = [t.end()]
        for costs in group["costs"][::-1]:
            ends.append([min(NEVER, *(costs[q * n + to] + ends[-1][to] for to in range(n))) for q in range(n)])
        ends = ends[::-1]
        q, firsts = t.start, []
        for costs, ranks, behind, here in zip(group["costs"], group["ranks"], ends[1:], ends):
            firsts.append(q)
            q = min((ranks[q * n + to], to) for to in range(n) if costs[q * n + to] + behind[to] == here[q])[1]
        before = [None, *group["last"][:-1]]
        return pd.DataFrame({"conv_id": group["conv_id"], "piece": group["piece"], "first": firsts, "behind": ends[1:], "before": before, "ends": [False] * (len(group) - 1) + [True]})

    return run


def _edited(grammar: Grammar):
    """The edits of each piece as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(grammar)
        for rows in _pieces(batches):
            fault, roles, texts, turns = (rows.column(c).to_pylist() for c in ("fault", "role", "text", "turn"))
            kinds = _kinds(fault, roles)
            first, behind, before, ends = (rows.column(c)[0].as_py() for c in ("first", "behind", "before", "ends"))
            after, _ = t.scan(kinds, t.end() if behind is None else behind)
            edits, q = t.trace(kinds, after, t.start if first is None else first)
            out, last = [], before or ""
            for i, steps in enumerate(edits):
                for letter, r in steps[:-1]:
                    out.append((None, letter, r, "", None, False, grammar.insert))
                letter, r = steps[-1]
                cost = {"D": grammar.delete, "K": grammar.keep, "R": grammar.rerole}[letter] + (grammar.truncated if kinds[i][2] and letter != "D" else 0)
                illegal = (i > 0 or before is not None) and last + roles[i][:1] not in grammar.follow
                out.append((turns[i], letter, r or roles[i], texts[i], fault[i], illegal, cost))
                last = roles[i][:1]
            if ends is not False:
                out += [(None, letter, r, "", None, False, grammar.insert) for letter, r in t.tail(q)[0]]
            columns = list(zip(*out))
            conv, piece = (pa.concat_arrays([rows.column(c).slice(0, 1).combine_chunks()]).take(pa.array([0] * len(out))) for c in ("conv_id", "piece"))
            kinds_of = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([conv, piece, pa.array(range(len(out)), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds_of))], ["conv_id", "piece", "place", "turn", "edit", "role", "text", "fault", "illegal", "cost"])

    return run


def repair(turns: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """The edits in order of (conv_id, piece, place): turn (null for inserted ones), edit (K, R, D, I), role and text after it,
    fault, illegal (the row may not follow the one before it, before any edit) and cost.

    The repaired conversation is the rows whose edit isn't D.
    """
    grammar = grammar or Grammar()
    # written, as they are read twice
    rows = cut(faulty(turns))
    kind = rows.schema["conv_id"].dataType.simpleString()
    long = rows.groupBy("conv_id").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high").select(F.col("conv_id").alias("__c"))
    longer = rows.join(long, F.col("conv_id").eqNullSafe(F.col("__c")), "left_semi").select("conv_id", "piece", "turn", "role", "text", "row", "fault")
    order = ("conv_id", "piece", "turn", "role", "text", "row")
    sorted_ = lambda df: df.repartition("conv_id", "piece").sortWithinPartitions(*order)
    ways = sorted_(longer).select("conv_id", "piece", "role", "fault").mapInArrow(_ways(grammar), f"conv_id {kind}, piece long, costs array<long>, ranks array<long>, last string")
    chain = ways.groupBy("conv_id").applyInPandas(_chain(grammar), f"conv_id {kind}, piece long, first int, behind array<long>, before string, ends boolean")
    chain = cut(chain.withColumnsRenamed({"conv_id": "__c", "piece": "__p"}))
    whole = rows.join(chain, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("piece") == F.col("__p")), "left").drop("__c", "__p")
    out = f"conv_id {kind}, piece long, place long, turn long, edit string, role string, text string, fault string, illegal boolean, cost long"
    return sorted_(whole).select("conv_id", "piece", "turn", "role", "text", "fault", "first", "behind", "before", "ends").mapInArrow(_edited(grammar), out)
