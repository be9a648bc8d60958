"""Chat formatting by a declarative template, with a finite-state machine over roles and loss flags by segment.

A template names, for each role, the marker that opens a turn and whether its text counts for the loss, the marker that
ends every turn, and the transitions of a finite-state machine over roles. Texts are escaped, so no control string of the
template, nor of the common formats, can occur in them; ``read_back`` undoes this from the formatted text alone. All steps
are DataFrame functions; conversations are grouped by conv_id, one row each, which the output needs as a whole.

Defined cases: turns are ordered by turn (nulls first), then role, then text, so ties and repeated rows have a fixed
order and stay; a null text is empty; a null or unknown role opens with the template's marker for other roles, which
carries the escaped role, is no valid turn and has no loss; a null conv_id is a conversation of its own; an empty table
gives an empty table; columns besides conv_id, turn, role and text are not looked at. valid says whether the machine
accepts the order of roles; conversations that it refuses are formatted too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Template:
    """opening: marker by role; other: (before, after) the name of any other role; close: ends a turn."""

    opening: dict[str, str] = field(default_factory=lambda: {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"})
    other: tuple[str, str] = ("<|role:", "<|>\n")
    close: str = "<|end|>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    #: (state, role) to state; the first state is "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: frozenset[str] = frozenset({"user", "assistant"})


#: Escapes by character. Every control string, of this template or of the usual ones, begins with < or [.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}


def escape(text: Column) -> Column:
    for char, mark in ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    """A backslash always begins a pair, so cutting at the pair of two leaves only the other two to undo."""

    def undo(part: Column) -> Column:
        for char, mark in ESCAPES.items():
            if char != "\\":
                part = F.replace(part, F.lit(mark), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), undo), "\\")


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, valid, segments (array of text and loss), formatted (all segment texts in turn)."""
    opening = _literal_map(template.opening)
    moves = _literal_map({f"{a}\n{r}": b for (a, r), b in template.moves.items()})
    one = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def segments(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        known = role.isin(*template.opening)
        head = F.when(known, F.try_element_at(opening, role)).otherwise(F.concat(F.lit(template.other[0]), escape(role), F.lit(template.other[1])))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escape(t["text"]), role.isin(*template.loss)), part(F.lit(template.close), F.lit(False)))

    state = F.aggregate(
        "turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), F.coalesce(t["role"], F.lit("")))), F.lit("refused"))
    )
    made = chats.select("conv_id", state.isin(*template.final).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return made.select("*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """formatted with turns (array of role and text), read from the column formatted alone."""
    pieces = F.split(F.col("formatted"), _quoted(template.close))
    names = _literal_map({mark: role for role, mark in template.opening.items()})
    before, after = template.other
    # a turn's opening marker ends at its first line break: markers hold one, at their end, and no role's name can
    heads = [mark.rstrip("\n") for mark in template.opening.values()]
    if any("\n" in h for h in heads) or any(not m.endswith("\n") for m in (*template.opening.values(), after)):
        raise ValueError("opening markers must end with their only line break")

    def turn(p: Column) -> Column:
        other = p.startswith(before)
        # another role's name may hold line breaks, but never the escaped "<" of a marker: it ends at its closing mark
        cut = F.when(other, F.instr(p, after) + len(after) - 1).otherwise(F.instr(p, "\n"))
        head = F.substring(p, F.lit(1), cut)
        role = F.when(other, unescape(F.substring(p, F.lit(len(before) + 1), cut - len(before) - len(after)))).otherwise(F.try_element_at(names, head))
        return F.struct(role.alias("role"), unescape(F.substring(p, cut + 1, F.length(p))).alias("text"))

    kept = let(pieces, lambda ps: F.transform(F.slice(ps, 1, F.size(ps) - 1), turn))
    return formatted.withColumn("turns", kept)


def _quoted(text: str) -> str:
    """text as a Java pattern."""
    return "\\Q" + text + "\\E"
