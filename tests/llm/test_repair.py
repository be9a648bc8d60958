"""Conversation repair against a plain search over all states, and in pieces of any length."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pairwave.llm import queries, repair

MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best(rows):
    """(cost, audit, repaired rows): from the last row on, the cheapest and then least audit from each state."""
    kinds, ahead = faults(rows), None
    for i in range(len(rows), -1, -1):
        now = dict.fromkeys(("", "s", "u", "a"))
        for q in now:
            ways = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
            if i < len(rows):
                _, role, text = rows[i]
                ways += [(ahead[q][0] + 3, "D" + ahead[q][1], ahead[q][2])]
                if kinds[i] not in ("blank", "duplicate"):
                    more = kinds[i] == "truncated"
                    for letter, cost, r in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                        to = MOVES.get((q, r[:1]))
                        if to is not None:
                            ways.append((ahead[to][0] + cost + more, letter + ahead[to][1], ((r, text), *ahead[to][2])))
            now[q] = min(ways, default=None)
        for _ in range(4):
            for q in now:
                for r in ("user", "assistant"):
                    to = MOVES.get((q, r[0]))
                    if to is not None and now[to] is not None:
                        way = (now[to][0] + 2, "I" + now[to][1], ((r, ""), *now[to][2]))
                        now[q] = way if now[q] is None else min(now[q], way, key=lambda w: w[:2])
        ahead = now
    return ahead[""]


def told(rows):
    cost, audit, out = best(rows)
    turns = {t for t, _, _ in rows if t is not None}
    kinds = Counter(faults(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


def damaged(given):
    made = defaultdict(list)
    for conv, turn, role, text in given:
        role, text, rows = " " if role is None else role, " " if text is None else text, made[conv]
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
        rows += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    return {c: told(in_order(rows)) for c, rows in made.items()}


def check_query(spark, folder):
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = queries.op11_conversation_repair(spark, folder).collect()
    assert len(rows) == len({r.conv_id for r in rows})
    assert {r.conv_id: tuple(r[n] for n in NAMES) for r in rows} == damaged(given)


@pytest.mark.parametrize("span", [512, 2])
def test_whole_table(spark, sf, monkeypatch, span):
    monkeypatch.setattr(repair, "SPAN", span)
    check_query(spark, sf)


@pytest.mark.parametrize("span", [512, 5, 1])
def test_odd_rows(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(repair, "SPAN", span)
    g = random.Random(6)
    texts = ["Yes.", "No!", "why", "  ", "", None, "tab\t.", " ", "So it is.\n", "x" * 50_000, "Yes."]
    roles = ["user", "assistant", "system", "tool", "", None, "USER", "under"]
    rows = [(g.choice([None, 1, 2, 3, 4, 5, 6]), g.choice([None, *range(-3, 12)]), g.choice(roles), g.choice(texts), "x", 1.0) for _ in range(200)]
    schema = "conv_id long, turn long, role string, text string, fault string, piece double"
    spark.createDataFrame([*rows, *rows[:10]], schema).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    check_query(spark, str(tmp_path))


def test_empty_table(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op11_conversation_repair(spark, str(tmp_path)).collect() == []
    assert repair.repair(spark.createDataFrame([], schema)).collect() == []


def test_a_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "SPAN", 7)
    g = random.Random(9)
    rows = [(i, g.choice(["user", "assistant", "assistant", "system"]), f"{g.randrange(400)}{g.choice(['.', '', '?'])}") for i in range(600)]
    got = repair.repair(spark.createDataFrame([("c", *r) for r in rows], "conv_id string, turn long, role string, text string").repartition(6))
    edits = sorted(got.collect(), key=lambda r: (r.piece, r.place))
    cost, audit, out = best(rows)
    assert "".join(r.edit for r in edits) == audit and sum(r.cost for r in edits) == cost
    assert [(r.role, r.text) for r in edits if r.edit != "D"] == list(out)
    assert [r.turn for r in edits if r.edit != "I"] == list(range(600))


def test_other_grammars_and_costs(spark):
    grammar = repair.Grammar(
        ends=frozenset({"user"}), moves={("start", "u"): "user", ("user", "t"): "tool", ("tool", "u"): "user"}, given=("tool", "user"), follow=("ut", "tu"), rerole=9, delete=1, insert=5,
    )
    rows = [("c", 1, "user", "A."), ("c", 2, "user", "B."), ("c", 3, "tool", "C."), ("c", 4, "user", "D.")]
    got = repair.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), grammar).orderBy("piece", "place").collect()
    assert "".join(r.edit for r in got) == "DKKK" and sum(r.cost for r in got) == 1 and sum(r.illegal for r in got) == 1


def test_the_table_fills_as_rows_are_met():
    t = repair.Tables(repair.Grammar())
    row = (False, "u", False)
    assert not t.steps
    after, _ = t.scan([row, (False, "a", False)] * 50, t.end())
    filled = len(t.steps)
    t.scan([row, (False, "a", False)] * 5000, t.end())
    assert 0 < len(t.steps) <= filled + 2 and len(after) == 100
