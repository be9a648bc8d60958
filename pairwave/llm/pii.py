"""Format-preserving pseudonyms for personal data: a keyed Feistel network permutes validated values within their format.

A value found in a text is validated (card numbers and IBANs by their check digits, addresses by the range of their
octets, dates by the calendar, IBANs also by their country's length, social security numbers by the areas in use),
normalised, and permuted within all values of its format under the key; of a phone number the digits after the country
code, whether that is set apart or not (numbers of three, three and four digits without one are of country 1). The result is again valid and keeps punctuation and length. Equal values, however written,
get equal pseudonyms in every document, and unequal values of one format unequal ones, without any table of values; so
there is no shuffle and nothing grows with the data. Whoever has the key can undo it (``undo=True``).

Defined cases: a null text stays null and an empty one empty, both with n_found 0; strings of any length are permuted, in
parts of PART characters that each depend on those before; a value that fails validation is left
as it is, and the search goes on after its first character; a value within such a match is permuted among those that undo finds
again, so its pseudonym may differ from that of the value elsewhere; a date with slashes is read month first where the
calendar allows it, else day first; repeated rows get the same text; an empty table gives an empty table; input columns are passed through, and one
named n_found is replaced.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import slices

ROUNDS = 10
#: Characters of a string that are permuted at once.
PART = 64


class Feistel:
    """Keyed permutations of number ranges and of strings over an alphabet."""

    def __init__(self, key: bytes, undo: bool = False):
        if not 16 <= len(key) <= 64:
            raise ValueError("the key needs 16 to 64 bytes")
        self.key, self.undo = key, undo

    def _halves(self, a: int, b: int, size_a: int, size_b: int, what: str) -> tuple[int, int]:
        """Alternating unbalanced rounds: each adds a keyed digest of one half to the other."""
        for i in reversed(range(ROUNDS)) if self.undo else range(ROUNDS):
            seen, size = (b, size_a) if i % 2 == 0 else (a, size_b)
            digest = blake2b(f"{what}|{i}|{seen}".encode(), key=self.key, digest_size=32).digest()
            step = int.from_bytes(digest, "big") % size
            step = -step if self.undo else step
            a, b = ((a + step) % size_a, b) if i % 2 == 0 else (a, (b + step) % size_b)
        return a, b

    def number(self, x: int, size: int, what: str) -> int:
        """A permutation of range(size). Values of the enclosing rectangle that fall outside are permuted again."""
        side = isqrt(size)
        other = -(-size // side)
        while True:
            a, b = self._halves(x // other, x % other, side, other, f"{what}/{size}")
            x = a * other + b
            if x < size:
                return x

    def text(self, chars: str, alphabet: str, what: str) -> str:
        """A permutation of the strings of this length over the alphabet."""
        if len(chars) > PART:
            made, seen = [], ""
            for at in range(0, len(chars), PART):
                part = chars[at : at + PART]
                new = self.text(part, alphabet, f"{what}/{seen}")
                seen = blake2b(f"{seen}{new if self.undo else part}".encode(), digest_size=16).hexdigest()
                made.append(new)
            return "".join(made)
        if not chars:
            return chars
        base, x = len(alphabet), 0
        for c in chars:
            x = x * base + alphabet.index(c)
        x = self.number(x, base ** len(chars), f"{what}/{base}")
        out = []
        for _ in chars:
            x, d = divmod(x, base)
            out.append(alphabet[d])
        return "".join(reversed(out))


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in turn."""
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in shape)


def _card(f: Feistel, s: str) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or not luhn(digits):
        return None
    body = digits[0] + f.text(digits[1:-1], DIGITS, "card")
    return _refill(s, next(body + c for c in DIGITS if luhn(body + c)))


#: Characters of an IBAN by country.
_IBAN = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in names.split()
}


def _iban(f: Feistel, s: str) -> str | None:
    """The new IBAN alone, which may end before s: the country tells its length, and s may run into the words that follow."""
    if s[:2] in _IBAN:
        ends = [i for i, c in enumerate(s, 1) if c != " "]
        if len(ends) < _IBAN[s[:2]]:
            return None
        end = ends[_IBAN[s[:2]] - 1]
        if s[end : end + 1].isalnum():
            return None
        s = s[:end]
    flat = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    country, body = flat[:2], flat[4:]
    digits = f.text("".join(c for c in body if c in DIGITS), DIGITS, "iban" + country)
    letters = f.text("".join(c for c in body if c in UPPER), UPPER, "iban" + country)
    d, u = iter(digits), iter(letters)
    body = "".join(next(d) if c in DIGITS else next(u) for c in body)
    made = iter(f"{country}{98 - number(body + country + '00') % 97:02d}{body}")
    return "".join(" " if c == " " else next(made) for c in s)


# Calling codes of one and two digits; all others have three.
_CALLING = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(f: Feistel, s: str) -> str | None:
    """The digits after the country code are permuted, but for a zero in brackets, which is dialled at home only."""
    if s[0] == "+":
        digits = re.match(r"\+(\d*)", s)[1]
        code = next((digits[:n] for n in (1, 2) if digits[:n] in _CALLING), digits[:3])
        head = "+" + code
    else:
        code, head = "1", (re.match(r"1(?=[ .\-])", s) or [""])[0]
    home = re.match(r"[ .\-]?\(0\)", s[len(head) :])
    head += home[0] if home else ""
    digits = re.sub(r"\D", "", s[len(head) :])
    if not 7 <= len(digits) <= 14:
        return None
    return head + _refill(s[len(head) :], f.text(digits, DIGITS, "phone+" + code))


def _ip(f: Feistel, s: str) -> str | None:
    octets = s.split(".")
    if any(len(o) > 1 and o[0] == "0" or int(o) > 255 for o in octets):
        return None
    x = f.number(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(f: Feistel, s: str) -> str | None:
    area, group, serial = map(int, s.split("-"))
    areas = [*range(1, 666), *range(667, 900)]
    if area not in areas or not group or not serial:
        return None
    x = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(f.number(x, len(areas) * 99 * 9999, "ssn"), 9999)
    x, group = divmod(x, 99)
    return f"{areas[x]:03d}-{group + 1:02d}-{serial + 1:04d}"


#: The dates of 1900 to 2099 whose day may be a month's number too, and those whose day can't. Each kind is permuted among
#: itself, so that a date that can only be read day first still can, and every way of writing takes the same permutation.
_DATES: tuple[list[datetime.date], list[datetime.date]] = ([], [])
for _n in range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()):
    _day = datetime.date.fromordinal(_n)
    _DATES[_day.day > 12].append(_day)
_PLACES = tuple({d: i for i, d in enumerate(kind)} for kind in _DATES)


def _date(order: str) -> Callable[[Feistel, str], str | None]:
    """Dates of the years 1900 to 2099; order is of the letters y, m, d."""

    def change(f: Feistel, s: str) -> str | None:
        parts = re.split(r"\D", s)
        try:
            day = datetime.date(**{{"y": "year", "m": "month", "d": "day"}[k]: int(v) for k, v in zip(order, parts)})
        except ValueError:
            return None
        late = day.day > 12
        if day not in _PLACES[late]:
            return None
        day = _DATES[late][f.number(_PLACES[late][day], len(_DATES[late]), "late date" if late else "date")]
        return s[re.search(r"\D", s).start()].join(f"{day.year:04d}" if k == "y" else f"{day.month if k == 'm' else day.day:02d}" for k in order)

    return change


_MONTH_FIRST, _DAY_FIRST = _date("mdy"), _date("dmy")


def _slashes(f: Feistel, s: str) -> str | None:
    """Month first where the calendar allows it, else day first; the pseudonym is read in the same order."""
    made = _MONTH_FIRST(f, s)
    return _DAY_FIRST(f, s) if made is None else made


def _classes(f: Feistel, s: str, what: str) -> str:
    """Each class of characters (digits, small and capital letters) permuted among itself; the rest stays."""
    for alphabet in (DIGITS, LOWER, UPPER):
        new = iter(f.text("".join(c for c in s if c in alphabet), alphabet, what))
        s = "".join(next(new) if c in alphabet else c for c in s)
    return s


def _email(f: Feistel, s: str) -> str | None:
    name, _, host = s.rpartition("@")
    host, _, top = host.rpartition(".")
    return f"{_classes(f, name.lower(), 'mail')}@{_classes(f, host.lower(), 'host')}.{top}"


def _secret(f: Feistel, s: str) -> str | None:
    head = re.match(r"[A-Za-z_\-]+\s*[=:]\s*[\"']?", s)[0]
    body = s[len(head) :]
    if not re.search(r"\d", body):
        return None
    if re.fullmatch(r"[0-9a-f]+", body) and not body.isdigit():
        # permuted among the strings that have both digits and letters, as this one has
        body = f.text(body, "0123456789abcdef", "hex")
        while body.isdigit() or not re.search(r"\d", body):
            body = f.text(body, "0123456789abcdef", "hex")
        return head + body
    return head + _classes(f, body, "secret")


#: In order of precedence where two begin at one place: kind, pattern, change.
KINDS: list[tuple[str, str, Callable[[Feistel, str], str | None]]] = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9_.+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.)+[A-Za-z]{2,24}\b", _email),
    ("secret", r"(?i:(?<![A-Za-z])(?:password|passwd|pwd|token|secret|api[_\-]?key|access[_\-]?key)\s?[=:]\s?[\"']?)[A-Za-z0-9_\-]{8,}", _secret),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    ("date", r"(?<![\d./\-])(?:19|20)\d\d-[01]\d-[0-3]\d(?![\d\-])", _date("ymd")),
    ("date", r"(?<![\d./\-])[0-3]\d\.[01]\d\.(?:19|20)\d\d(?!\d)", _date("dmy")),
    ("date", r"(?<![\d./\-])[0-3]\d/[0-3]\d/(?:19|20)\d\d(?!\d)", _slashes),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", _ssn),
    ("card", r"(?<![\d+])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)", _card),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)", _phone),
    ("phone", r"(?<![\w.+\-])1[ .\-](?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\d\-])", _phone),
    ("phone", r"(?<![\w+(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)", _phone),
    ("phone", r"(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])", _phone),
]
_ANY = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p, _) in enumerate(KINDS)))
_EACH = [re.compile(p) for _, p, _ in KINDS]
_HINT = re.compile(r"[0-9@]")


def pseudonymise(text: str | None, f: Feistel) -> tuple[str | None, int]:
    """The text with pseudonyms, and how many values were replaced."""
    if not text or not _HINT.search(text):
        return text, 0
    n, done, at, out = 0, 0, 0, []
    failed: list[tuple[int, int, int]] = []  # kind, start and end of matches that were no values
    while m := _ANY.search(text, at):
        start = m.start()
        for kind in range(int(m.lastgroup[1:]), len(KINDS)):
            m = _EACH[kind].match(text, start)
            made = m and KINDS[kind][2](f, m[0])
            if made is not None:
                break
            if m:
                failed.append((kind, start, m.end()))
        at = start + 1
        if made is None:
            continue
        end = start + len(made) if KINDS[kind][0] == "iban" else m.end()
        failed = [x for x in failed if x[2] > start]
        if failed:
            made = _apart(text, start, end, made, kind, f, failed)
        out += [text[done:start], made]
        done = at = end
        n += 1
    return "".join([*out, text[done:]]), n


def _apart(text: str, start: int, end: int, made: str, kind: int, f: Feistel, failed: list[tuple[int, int, int]]) -> str:
    """made, permuted again until no match that failed before around this place is a value now, so that undo finds it."""

    def value(k: int, begin: int) -> bool:
        m = _EACH[k].match(text[:start] + made + text[end:], begin)
        return bool(m) and KINDS[k][2](f, m[0]) is not None

    while any(value(k, begin) for k, begin, _ in failed):
        made = KINDS[kind][2](f, made)
    return made


def protect(docs: DataFrame, key: bytes, *, undo: bool = False) -> DataFrame:
    """docs with pseudonyms in text, and n_found."""
    passed = [c for c in docs.columns if c.lower() != "n_found"]
    at = passed.index("text")
    schema = T.StructType([*(docs.schema[c] for c in passed), T.StructField("n_found", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key, undo)
        for batch in batches:
            for begin, end in slices(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
                part = batch.slice(begin, end - begin)
                made = [pseudonymise(t, f) for t in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array([t for t, _ in made], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in made], pa.int64())], [*passed, "n_found"])

    return docs.select(*passed).mapInArrow(run, schema)
