"""Plain versions of the operators, for small tables."""

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def fingerprint(text, size=4):
    ws = words(lower_ascii(text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    """The least index reachable from each, over all pairs."""
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def simhash_components(rows, size=4, bits=4):
    """{doc_id: smallest doc_id of its component} of (doc_id, text) with unique ids."""
    rows = sorted(rows)
    prints = [fingerprint(t, size) for _, t in rows]
    found = groups(prints, lambda a, b: (a ^ b).bit_count() <= bits)
    return {d: rows[g][0] for (d, _), g in zip(rows, found)}, {d: f"{p:016x}" for (d, _), p in zip(rows, prints)}


def _common(texts):
    """Places (text, line) of lines with a word, the lines, and for each two places how many lines follow alike."""
    places = [(d, i) for d, t in enumerate(texts) if t is not None for i, x in enumerate(t.split("\n")) if words(x)]
    lines = [texts[d].split("\n")[i] for d, i in places]
    n = len(places)
    number = {}
    ids = np.array([number.setdefault(x, len(number)) for x in lines], int)
    ends = np.array([k + 1 == n or places[k + 1][0] != places[k][0] for k in range(n)], bool)
    lcp = np.zeros((n + 1, n + 1), np.int32)
    for i in reversed(range(n)):
        lcp[i, :n] = np.where(ids == ids[i], 1 + np.where(ends | ends[i], 0, lcp[i + 1, 1:]), 0)
    return places, lines, lcp


def without_repeats(texts, min_words=5):
    """Texts (in order) without the lines of runs with min_words words or more that stand at an earlier place too."""
    places, lines, lcp = _common(texts)
    gone = set()
    for i in range(len(places)):
        size = lcp[i, :i].max(initial=0)
        if sum(len(words(x)) for x in lines[i : i + size]) >= min_words:
            gone.update(places[i : i + size])
    out = []
    for d, t in enumerate(texts):
        out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone))
    return out


def repeated_runs(texts, min_words=5):
    """(text, first line, lines) of every run that stands at another place too and can't be longer at either end."""
    places, lines, lcp = _common(texts)
    n, out = len(places), set()
    size = [max(lcp[i, :i].max(initial=0), lcp[i, i + 1 :].max(initial=0)) for i in range(n)]
    for i in range(n):
        inner = i and places[i - 1][0] == places[i][0] and size[i - 1] == size[i] + 1
        if size[i] and not inner and sum(len(words(x)) for x in lines[i : i + size[i]]) >= min_words:
            out.add((*places[i], size[i]))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    ws = words(text)
    full = [x for x in text.split("\n") if words(x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), sum(x in full[:i] for i, x in enumerate(full)), len(marked), n < 50 or 100 * len(marked) > 50 * n


def bad_line(line, follow, phrases):
    """The line rules with their production limits, by looking at characters and words only."""
    ws = line.split()
    low = line.lower()
    menu = [w for w in ws if w in ("|", ">", "/", "»", "›", "·", "•", "«", "‹", "–")]
    if len(menu) >= 2 and 5 * len(menu) >= len(ws):
        return True
    if 2 * sum(c in "#*$%&|<>" for c in line) > len(ws):
        return True
    shouted = [w for w in ws if w.rstrip(".,").endswith("!!")]
    if len(ws) >= 3 and 10 * len(shouted) > 4 * len(ws):
        return True
    if len(ws) <= 30 and any(p in low for p in phrases):
        return True
    ends = ".!?:;…。！？\"'”’»)]"
    if line.rstrip()[-1] in ends:
        return False
    head = ws[0].strip("()")
    if len(ws) > 1 and (ws[0] in ("-", "*", "•", "–") or (ws[0][-1] in ".)" and (head.rstrip(".").isdigit() or len(head.rstrip(".")) == 1) and len(head) < 5)):
        return False
    for w in line.rstrip().split()[:-1]:
        if w.rstrip("\"'”’»)]")[-1:] in (".", "!", "?", "…"):
            return False
    return not (len(ws) <= 12 and follow.rstrip()[-1:] and follow.rstrip()[-1:] in ends)


def verdict(text, phrases):
    """(clean text, removed lines, kept) with a loss of at most 0.4 of the characters of lines with a word."""
    lines = (text or "").split("\n")
    full = [x for x in lines if words(x)]
    after = dict(zip(range(len(full)), [*full[1:], ""]))
    clean, lost, removed, seen = [], 0, 0, 0
    for x in lines:
        if words(x):
            follow, seen = after[seen], seen + 1
            if bad_line(x, follow, phrases):
                lost, removed = lost + len(x), removed + 1
                continue
        clean.append(x)
    base = quality(text)[-1]
    return "\n".join(clean), removed, not base and lost <= 0.4 * max(1, sum(map(len, full)))


@lru_cache(maxsize=1)
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def token_ids(texts):
    t = _tokenizer()
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4") for x in texts]


# ---- order MinHash, by the definition in the operator's docstring, with Spark's xxhash64 (XXH64, seed 42, chained)

MASK = (1 << 64) - 1


def _signed(x):
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def _hash(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, h)
    return _signed(h)


def _long(x):
    return (x & MASK).to_bytes(8, "little")


def order_minhash(text, slots=32, picks=2, place=28):
    ws = [w.encode() for w in words(text)]
    low = (1 << place) - 1
    number, keyed = Counter(), []
    for i in range(len(ws)):
        kmer = _hash(*ws[i : i + 2]) >> place
        keyed.append((_hash(_long(kmer), number[kmer].to_bytes(4, "little")) & ~low | i))
        number[kmer] += 1
    out, bits = [], 59
    for slot in range(-slots // 2, slots // 2):
        mine = sorted(x for x in keyed if x >> bits == slot)[:picks]
        if mine:
            order = [x >> place for x in sorted(mine, key=lambda x: (x & low, x >> place))]
            out.append((slot + slots // 2) << 27 | _hash(*map(_long, order)) & ((1 << 27) - 1))
    return "".join(f"{x:08x}" for x in out)


def likeness(a, b):
    a, b = ([s[i : i + 8] for i in range(0, len(s), 8)] for s in (a, b))
    either = {int(x, 16) >> 27 for x in a + b}
    return len(set(a) & set(b)) / len(either) if either else 1.0
