"""Byte-level BPE with a segment tree of pair ranks.

A text is cut by the vocabulary's pattern; in each match the pair of neighbouring tokens with the lowest rank, leftmost
first, is merged until no pair has a rank. The match's byte positions are the leaves of a segment tree: a leaf holds the
rank of the pair that begins there (with the position as tie-break), an inner node the least of its leaves, so the root is
the leftmost minimum. A merge changes the leaf of the merged token, of the token that vanished and of its live left
neighbour, each with its path to the root. The trees of many short matches are rows of one array and advance together,
one merge a step; long matches advance alone.

Distinct matches are merged once a worker and kept in a bounded table. Documents are encoded where they are read, with no
shuffle. Defined cases: a null or empty text has no IDs and decodes to no bytes; a text is encoded in full at any length;
repeated rows are encoded alike; an empty table gives an empty table; input columns are passed through, and one named ids
or decoded is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh
from .tokens import Pieces, slices

NONE = np.iinfo(np.int64).max
#: Leaves beyond which a match has a tree of its own, and most trees in one array.
LONG, TREES = 256, 4096
#: Bytes of text that are encoded at a time.
AT_ONCE = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a file with a line of base64 and a number for each token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Merger:
    """Merges of byte strings by rank; a token's ID is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 2
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.values = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], 0)
        self.pairs = pairs
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values of pairs; a token of -1 is no token."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at] << 32 | place, NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The IDs of each word; words aren't empty."""
        out: list[np.ndarray | None] = [None] * len(words)
        by_leaves: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            rank = self.ranks.get(w)
            if rank is not None:
                out[i] = np.array([rank], np.int32)
            else:
                by_leaves.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
        for leaves, members in by_leaves.items():
            if leaves > LONG:
                for i in members:
                    out[i] = self._alone(words[i], leaves)
            else:
                for at in range(0, len(members), TREES):
                    part = members[at : at + TREES]
                    for i, ids in zip(part, self._together([words[i] for i in part], leaves)):
                        out[i] = ids
        return out

    def _together(self, words: list[bytes], leaves: int) -> list[np.ndarray]:
        """Words of up to that many bytes (a power of two), one tree a row."""
        n, depth = len(words), leaves.bit_length() - 1
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(n, leaves)
        sizes = np.fromiter(map(len, words), np.int64, n)
        # one column more: behind the last token stands no token
        token = np.full((n, leaves + 1), -1, np.int64)
        token[:, :leaves] = np.where(np.arange(leaves) < sizes[:, None], self.bytes[raw], -1)
        after = np.minimum(np.arange(1, leaves + 2), sizes[:, None]) + np.zeros((n, 1), np.int64)
        after[np.arange(leaves + 1) >= sizes[:, None]] = leaves
        after[after == sizes[:, None]] = leaves
        before = np.tile(np.arange(-1, leaves), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        places = np.tile(np.arange(leaves), (n, 1))
        tree[:, leaves:] = self._leaves(token[:, :-1], token[:, 1:], places)
        for level in reversed(range(depth)):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, 2 * a : 2 * b : 2], tree[:, 2 * a + 1 : 2 * b : 2])

        def update(rows: np.ndarray, place: np.ndarray, value: np.ndarray | int) -> None:
            node = place + leaves
            tree[rows, node] = value
            for _ in range(depth):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            rows, root = rows[root != NONE], root[root != NONE]
            if not len(rows):
                break
            place, rank = root & 0xFFFFFFFF, root >> 32
            gone = after[rows, place]
            follow = after[rows, gone]
            token[rows, place], token[rows, gone], after[rows, place] = rank, -1, follow
            before[rows, follow] = place
            update(rows, gone, NONE)
            update(rows, place, self._leaves(rank, token[rows, follow], place))
            left = before[rows, place]
            has = left >= 0
            r, left = rows[has], left[has]
            update(r, left, self._leaves(token[r, left], rank[has], left))
        live = token[:, :leaves] >= 0
        return np.split(token[:, :leaves][live].astype(np.int32), np.cumsum(live.sum(axis=1))[:-1])

    def _alone(self, word: bytes, leaves: int) -> np.ndarray:
        """The same for one long word, with plain lists."""
        n, find, size = len(word), self.pairs.get, self.size
        token = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [NONE] * (2 * leaves)

        def leaf(place: int) -> int:
            follow = after[place]
            rank = find(token[place] * size + token[follow]) if follow >= 0 else None
            return NONE if rank is None else rank << 32 | place

        def update(place: int, value: int) -> None:
            node = place + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for i in range(n):
            tree[leaves + i] = leaf(i)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != NONE:
            place, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone = after[place]
            token[place], token[gone] = rank, -1
            after[place] = after[gone]
            if after[place] >= 0:
                before[after[place]] = place
            update(gone, NONE)
            update(place, leaf(place))
            if before[place] >= 0:
                update(before[place], leaf(before[place]))
        return np.array([t for t in token if t >= 0], np.int32)


#: A space with text on both sides: the pattern always gives it to what follows, so texts may be cut there.
_CUT, _ODD = re.compile(r"(?<=\S) (?=\S)"), re.compile(r" \s|\s ")


class Codec:
    """Encodes and decodes texts by a rank file and its pattern."""

    def __init__(self, path: str, pattern: str):
        self.merger = Merger(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * self.merger.size
        for token, rank in self.merger.ranks.items():
            self.tokens[rank] = token
        self.pieces = Pieces(self._learn)

    def _learn(self, pieces: list[str | tuple[str]]) -> tuple[np.ndarray, np.ndarray]:
        """IDs of pieces, the stretches of a text between two cuts: the first in a tuple, the others without their space."""
        cut = [self.find(p[0] if isinstance(p, tuple) else " " + p) for p in pieces]
        words = list({w for c in cut for w in c})
        ids = dict(zip(words, self.merger.merge([w.encode("utf-8", "surrogatepass") for w in words])))
        parts = [ids[w] for c in cut for w in c]
        sizes = np.fromiter((sum(len(ids[w]) for w in c) for c in cut), np.int64, len(cut))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The int32 IDs of each text."""
        cut = []
        for t in texts:
            pieces = _CUT.split(t) if t and _ODD.search(t) else (t or "").split(" ")
            pieces[0] = (pieces[0],)
            cut.append(pieces)
        return self.pieces.ids(cut)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, pattern: str, *, decoded: bool = False, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns in carry) with ids, an array of the text's token IDs; decoded adds the bytes that they spell."""
    added = ["ids", *["decoded"] * decoded]
    passed = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    source = docs.select(*[docs[c] for c in passed], docs["text"].alias(fresh(passed, "text")))
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.BinaryType())] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            texts = batch.column(len(passed))
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), AT_ONCE):
                found = codec.encode(texts.slice(a, b - a).to_pylist())
                ends = np.concatenate(([0], np.cumsum(list(map(len, found))))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                made = [ids, *[pa.array([codec.decode(x) for x in found], pa.binary())] * decoded] if decoded else [ids]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(passed)]), *made], [*passed, *added])

    return source.mapInArrow(run, T.StructType([*(docs.schema[c] for c in passed), *more]))
