"""Line-first quality cleaning.

Every line is judged on its own by punctuation, navigation and boilerplate rules; failing lines go; a document that
loses too much of its text that way, or fails the base counts, is rejected. One pass over whole texts, no shuffle.

Defined cases: a null or empty text has no words and fails the base rule (its clean text is empty); lines without a
word are kept as they are; repeated rows are judged alike; an empty table gives an empty table; input columns are
passed through, and one that bears the name of an output column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh
from .tokens import slices

SYMBOLS = "#*$%&|<>"

# Phrases of licence, cookie and site-furniture lines in the four languages of the corpus.
BOILERPLATE = (
    "licensed under", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "accept cookies", "use of cookies", "enable javascript", "click here", "sign up for", "subscribe to our",
    "share this page", "back to top", "skip to content", "powered by", "copyright (c)", "released under the",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "accepter les cookies",
    "conditions d'utilisation", "cliquez ici", "abonnez-vous", "retour en haut",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "hier klicken",
    "newsletter abonnieren", "nach oben", "impressum",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "aceptar cookies",
    "haga clic aquí", "suscríbete a", "volver arriba",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.I)
#: What may stand at the end of a sentence, closing quotes and brackets included.
_ENDS = tuple(".!?:;…。！？\"'”’»)]")
_MENU = frozenset("| > / » › · • « ‹ –".split())
#: A list item: a bullet, or a number or letter with a stop or bracket, and then text.
_ITEM = re.compile(r"\s*(?:[-*•–]|\(?(?:\d{1,3}|[A-Za-z])[.)])\s+\S")
#: A sentence ends within the line.
_INNER = re.compile(r"[.!?…][\"'”’»)\]]*\s")
#: Most words of a heading.
HEADING = 12

OUTPUTS = T.StructType(
    [
        T.StructField("clean_text", T.StringType()),
        *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_removed")),
        T.StructField("lost_share", T.DoubleType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text holds twice or more, first windows included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = ids[:-2] * len(number) + ids[1:-1]
    if len(number) >= 1 << 20:  # three numbers no longer fit one integer
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * len(number) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= twice
    return int(marked.sum())


def line_fails(line: str, max_symbols: float, max_shouted: float, follow: str = "") -> str | None:
    """The rule that a line with a word fails, or None; follow: the next line with a word.

    A line without a sentence's end at its end fails by punctuation unless one ends within it, it is a list item, or it is
    a heading: short, and followed by a line that ends like a sentence.
    """
    words = line.split()
    n = len(words) or 1
    if sum(w in _MENU for w in words) >= max(2, 0.2 * n):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > max_symbols * n:
        return "punctuation"
    if n >= 3 and sum(w.rstrip(".,").endswith("!!") for w in words) > max_shouted * n:
        return "punctuation"
    if len(words) <= 30 and _BOILERPLATE.search(line):
        return "boilerplate"
    if line.rstrip().endswith(_ENDS) or _ITEM.match(line) or _INNER.search(line):
        return None
    return None if n <= HEADING and follow.rstrip().endswith(_ENDS) else "punctuation"


def judge(text: str | None, max_lost: float, max_symbols: float, max_shouted: float) -> tuple:
    """One row of OUTPUTS."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = text.split("\n")
    full = [x for x in lines if x.strip(" \t\v\f\r")]
    repeats = repeated_words(words)
    clean, lost, removed = [], 0, 0
    rest = iter([*full[1:], ""])
    for line in lines:
        if line.strip(" \t\v\f\r") and line_fails(line, max_symbols, max_shouted, next(rest)):
            removed += 1
            lost += len(line)
        else:
            clean.append(line)
    share = lost / max(1, sum(map(len, full)))
    base = n < 50 or 100 * repeats > 50 * n
    dup = len(full) - len(set(full))
    return "\n".join(clean), n, word_chars, sum(map(text.count, SYMBOLS)), dup, repeats, removed, share, base, not base and share <= max_lost


def clean_lines(
    docs: DataFrame, *, text: str = "text", max_lost: float = 0.4, max_symbols: float = 0.5, max_shouted: float = 0.4, carry: list[str] | None = None
) -> DataFrame:
    """docs (or its columns in carry) with the OUTPUTS of judge().

    max_lost: the largest share of the characters of non-blank lines that a kept document may lose; max_symbols: symbol
    characters a word; max_shouted: share of words that end in "!!".
    """
    names = {f.name for f in OUTPUTS}
    passed = [c for c in (docs.columns if carry is None else carry) if c.lower() not in names]
    source = docs.select(*[docs[c] for c in passed], docs[text].alias(fresh(passed, "text")))
    schema = T.StructType([*[docs.schema[c] for c in passed], *OUTPUTS])
    kinds = pa.schema([("clean_text", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_removed")), ("lost_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(pc.fill_null(pc.binary_length(batch.column(len(passed))), 0).to_pylist()):
                part = batch.slice(at, end - at)
                rows = [judge(t, max_lost, max_symbols, max_shouted) for t in part.column(len(passed)).to_pylist()]
                made = [pa.array(list(c), k.type) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(passed)], *made], [*passed, *kinds.names])

    return source.mapInArrow(run, schema)
