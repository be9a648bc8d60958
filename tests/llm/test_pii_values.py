"""Pseudonyms against a finder and validators of their own: no value is left, equal ones stay equal, formats hold."""

import datetime
import ipaddress
import random
import re

import pytest

from pairwave.llm import pii, queries

KEY = b"0123456789abcdef"


def _luhn(digits):
    ds = [int(c) for c in reversed(digits)]
    return (sum(ds[::2]) + sum(sum(divmod(2 * d, 10)) for d in ds[1::2])) % 10 == 0


def _kind(token):
    """The kind of value that a white-space token is, by plain checks, or None."""
    token = token.strip(".,;:()\"'")
    name, at, host = token.partition("@")
    if at and name and "." in host.strip(".") and re.fullmatch(r"[\w.+-]+", name, re.A) and re.fullmatch(r"[a-zA-Z0-9.-]+[a-zA-Z]", host):
        return "email", token
    if token.isascii() and token.isdigit() and 13 <= len(token) <= 19 and token[0] in "23456" and _luhn(token):
        return "card", token
    if token.count(".") == 3 and re.fullmatch(r"[0-9.]+", token):
        try:
            return "ip", str(ipaddress.IPv4Address(token))
        except ValueError:
            return None
    if re.fullmatch(r"\d{4}-\d\d-\d\d", token, re.A):
        try:
            return ("date", token) if 1900 <= datetime.date.fromisoformat(token).year < 2100 else None
        except ValueError:
            return None
    return None


def test_whole_table(spark, sf):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    after = {r.doc_id: r.text for r in queries.op3_pii(spark, sf).collect()}
    assert before.keys() == after.keys()
    names, back, seen = {}, {}, 0
    for d, text in before.items():
        old, new = text.split(), after[d].split()
        assert len(old) == len(new)
        for a, b in zip(old, new):
            kind = _kind(a)
            if kind:
                seen += 1
                other = _kind(b)
                assert other and other[0] == kind[0] and other[1] != kind[1]
                key = (kind[0], kind[1].lower())
                assert names.setdefault(key, other[1]) == other[1]
                assert back.setdefault((kind[0], other[1]), key) == key
    assert seen > 10


@pytest.mark.parametrize("n", [65, 300, 10_000])
def test_very_long_values(n):
    rng = random.Random(n)
    hexes = "".join(rng.choices("0123456789abcdef", k=n))
    mixed = "".join(rng.choices("0123456789abcXYZ_", k=n))
    host = ".".join(["h" * 60 + "7"] * (n // 60))
    for text in (f"token={hexes} end", f"secret: {mixed}", "pwd=" + "9" * n, f"mail ann@{host}.com now"):
        made, count = pii.pseudonymise(text, pii.Feistel(KEY))
        assert count == 1 and made != text and len(made) == len(text)
        assert [c.isdigit() for c in made] == [c.isdigit() for c in text] or "token" in text
        assert pii.pseudonymise(made, pii.Feistel(KEY, undo=True)) == (text, 1)


def test_phones_of_one_number_stay_one():
    ways = ["+1 604 234 0199", "+16042340199", "1-604-234-0199", "(604) 234-0199", "604-234-0199", "604.234.0199", "+1 (604) 234-0199"]
    made = [re.sub(r"\D", "", pii.pseudonymise(w, pii.Feistel(KEY))[0])[-10:] for w in ways]
    assert set(made) != {"6042340199"} and len(set(made)) == 1
    ways = ["+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958"]
    made = [pii.pseudonymise(w, pii.Feistel(KEY))[0] for w in ways]
    assert all(m.startswith("+44") for m in made) and len({re.sub(r"\D", "", m.replace("(0)", "")) for m in made}) == 1
    for w in ways:
        assert pii.pseudonymise(pii.pseudonymise(w, pii.Feistel(KEY))[0], pii.Feistel(KEY, undo=True)) == (w, 1)
