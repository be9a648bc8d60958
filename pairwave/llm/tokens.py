"""Token IDs of whole texts, packing without crossing documents, and a patched frame-of-reference file format.

Encoding. The vocabulary's pattern never matches across white space, so a text's IDs are those of its white-space pieces
one after another; the tokenizers library encodes each distinct piece once and a bounded table of pieces serves the rest.
Where the pattern takes letters and marks apart, a word is encoded once with whatever marks it closes.

Packing. A document of n IDs is cut into pieces of 4096, then into the powers of two of the remainder, largest first.
Each piece is a sequence of its own, and sequences of equal length form a bucket: none crosses documents, none is padded.

Files. Values are cut into blocks of BLOCK; a block stores its minimum, the differences packed at the width that holds a
percentile of them, and the places and values of the rest. An index of block starts and a table of documents close the file:

    magic (8 bytes) | blocks | documents: id int64, null uint8, n_tokens uint64 each | block starts: uint64 each |
    n_values uint64 | n_docs uint64 | n_blocks uint64 | magic
    block: minimum uint32 | width uint8 | 0 uint8 | n_values uint16 | n_exceptions uint16 | packed | places uint16 | values uint32

All integers are little-endian, packed values lowest bit first.

Defined cases: a null or empty text has no IDs of its own, only the end ID; documents are written by doc_id (nulls first),
ties by text; repeated rows are separate documents; an empty table gives empty results; other columns are not looked at;
the text of a special token of the vocabulary has that token's ID, as with a plain call of the library.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint

#: Pieces that an encoder remembers; their IDs are at most 8 times as many.
MOST_PIECES = 400_000
#: Bytes of text that are encoded, and of IDs that are passed on, at a time.
AT_ONCE = 1 << 20


class Pieces:
    """A bounded table of the IDs of pieces of text; learn(pieces) gives all IDs of new ones in turn, and how many each has."""

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self._forget()

    def _forget(self) -> None:
        self.number: dict[object, int] = {}
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0

    def _add(self, pieces: list) -> None:
        flat, sizes = self.learn(pieces)
        first, total = len(self.number), len(flat)
        while first + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.sizes[first : first + len(sizes)] = sizes
        self.starts[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = flat
        self.used += total
        self.number.update(zip(pieces, range(first, first + len(pieces))))

    def each(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """The int32 IDs of the pieces in turn, and where each piece's begin, with their end."""
        rows = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(rows < 0)
        if len(new):
            lacking = [pieces[i] for i in new.tolist()]
            self._add(list(dict.fromkeys(lacking)))
            rows[new] = np.fromiter(map(self.number.__getitem__, lacking), np.int64, len(lacking))
        sizes = self.sizes[rows]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        out = _ranges(self.flat, self.starts[rows], sizes)
        # long texts without a place to cut count by their IDs
        if len(self.number) > MOST_PIECES or self.used > 8 * MOST_PIECES:
            self._forget()
        return out, ends

    def ids(self, cut: list[list]) -> list[np.ndarray]:
        """The int32 IDs of texts that are given as lists of pieces."""
        out, ends = self.each([p for c in cut for p in c])
        bounds = ends[np.concatenate(([0], np.cumsum(list(map(len, cut)), dtype=np.int64)))]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _ranges(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat of these starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


#: Small letters that no normalisation changes, and marks that close a word; each side is one match of PATTERN.
PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,!?;:]*)")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

#: A character that stands between pieces when they are encoded together, and how many are.
MARK, TOGETHER = "\x01", 1000


class Encoder:
    """IDs of whole texts by a vocabulary file of the tokenizers library, as without special tokens.

    New pieces are encoded together, as one text with a mark between them. The vocabularies are of bytes, and the mark's
    byte occurs in no other character, so the mark's ID ends each piece; a piece that holds the mark is encoded alone.

    If each match of PATTERN is encoded by itself and ends with a token of a suffix, then plain words and the marks behind
    them are parts that are learnt once for all pieces, and need no mark between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts of special tokens, which the library finds before anything else; a text that holds one is encoded whole.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The same in small letters, which folding may make of others.
        self.folded_special = [t.lower() for t in self.special]
        self.pieces = Pieces(self._learn)
        self.mark = self._ids([MARK])[0]
        self.folds = all(self._ids([c]).tolist() == self._ids([c.lower()]).tolist() for c in ascii_uppercase)
        #: Which IDs end a match of the pattern, if they tell.
        self.ends = self._endings()
        self.parts = Pieces(self._learn_parts)

    def _endings(self) -> np.ndarray | None:
        kind = json.loads(self.tokenizer.to_str())
        split, normal, suffix = kind["pre_tokenizer"] or {}, kind["normalizer"] or {}, kind["model"].get("end_of_word_suffix")
        first, *rest = split.get("pretokenizers") or [{}]
        apart = first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
        bytewise = [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        if not (suffix and apart and bytewise and normal.get("normalizers") == NORMALISED and kind["model"].get("dropout") is None):
            return None
        vocabulary = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        return ends

    def _ids(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        if self.ends is None:
            return self._learn_marked(texts)
        plain, parts, other = np.ones(len(texts), bool), [], []
        for i, x in enumerate(texts):
            if m := PLAIN.fullmatch(x):
                parts += m.groups()
            else:
                plain[i] = False
                other.append(x)
        known, ends = self.parts.each(parts)
        flat, more = self._learn_marked(other)
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain], sizes[~plain] = np.diff(ends[::2]), more
        starts = np.zeros(len(texts), np.int64)
        starts[plain], starts[~plain] = ends[:-1:2], len(known) + np.cumsum(more) - more
        return _ranges(np.concatenate((known, flat)), starts, sizes), sizes

    def _learn_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts may be empty."""
        some = [x for x in parts if x]
        ids = self._ids([" ".join(some[a : a + TOGETHER]) for a in range(0, len(some), TOGETHER)])
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(some):
            raise ValueError("the vocabulary does not end each part by its suffix")
        sizes = np.zeros(len(parts), np.int64)
        sizes[[bool(x) for x in parts]] = np.diff(ends, prepend=-1)
        return ids, sizes

    def _learn_marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        own = {i: self._ids([t]) for i, t in enumerate(texts) if MARK in t}
        texts = ["" if i in own else t for i, t in enumerate(texts)] if own else texts
        between = f" {MARK} "
        ids = self._ids([between.join(texts[a : a + TOGETHER]) + between for a in range(0, len(texts), TOGETHER)])
        ends = np.flatnonzero(ids == self.mark)
        sizes = np.diff(ends, prepend=-1) - 1
        if len(sizes) != len(texts):
            raise ValueError("the vocabulary does not keep marked pieces apart")
        if not own:
            return np.delete(ids, ends), sizes
        parts = [own.get(i, ids[e - n : e]) for i, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist()))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The int32 IDs of each text."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        low = [self._folded(x) for x in raw]
        whole = {}
        for i, x in enumerate(low):
            if any(t in x for t in self.special if x is raw[i]) or x is not raw[i] and any(t in x for t in self.folded_special):
                # found before anything else if it stands so in the text itself, else only made by folding
                low[i] = raw[i]
                if any(t in raw[i] for t in self.special):
                    whole[i] = self._ids([raw[i].decode("utf-8", "replace")])
        found = self.pieces.ids([[] if i in whole else x.split() for i, x in enumerate(low)])
        return [whole.get(i, x) for i, x in enumerate(found)] if whole else found

    def _folded(self, raw: bytes) -> bytes:
        """Capitals as small letters where the vocabulary takes them alike, so that fewer pieces differ.

        A text with combining marks (U+0300 to U+037F begin with these bytes) stays: some compose with small letters only.
        """
        return raw.lower() if self.folds and b"\xcc" not in raw and b"\xcd" not in raw else raw


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks that a worker runs in turn, so common pieces are learnt once."""
    return Encoder(path)


def slices(sizes: list[int], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about most bytes in all."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids of documents, their token IDs with the end ID) of a part at a time; batches have doc_id and text."""
    encode = encoder(path).encode
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            found = encode(texts.slice(a, b - a).to_pylist())
            yield ids[a:b], [np.append(x, np.int32(end)) for x in found]


# ---- packing


def pieces_of(n: int, longest: int) -> list[int]:
    """n as pieces of the longest size, then the powers of two of the remainder."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, path: str, *, longest: int = 4096, end: int = 2) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (uint32), doc_tokens, sequence_id, offset, bucket.

    bucket is the binary logarithm of the length. A sequence ID has the bucket in its highest bits, then the task's
    partition, then a count within both: unique without a shuffle, and each bucket's IDs lie together. docs is cut into
    partitions as it is read, so a task that runs again gives its rows the same IDs.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    fields = [T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.LongType(), T.IntegerType()]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in zip(names[1:], fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        counts = [0] * longest.bit_length()
        for ids, tokens in encoded(batches, path, end):
            rows = []
            for doc, x in zip(ids, tokens):
                raw, start = x.astype("<u4").tobytes(), 0
                for size in pieces_of(len(x), longest):
                    bucket = size.bit_length() - 1
                    rows.append((doc, start, size, raw[4 * start : 4 * (start + size)], len(x), bucket << 58 | part << 34 | counts[bucket], 0, bucket))
                    counts[bucket] += 1
                    start += size
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))], names)

    id_type = _arrow_type(docs, "doc_id")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


# ---- files

MAGIC, BLOCK = b"PFOR\x00\x01\r\n", 4096
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("n", "<u2"), ("odd", "<u2")])
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")])
_TAIL = 3 * 8 + len(MAGIC)


def encode_block(values: np.ndarray, percentile: float = 95.0) -> bytes:
    """One block of up to BLOCK unsigned 32-bit values, at least one."""
    low = int(values.min())
    rest = values.astype(np.int64) - low
    at = int(np.ceil(percentile / 100 * (len(rest) - 1)))
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> width)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    head = np.array([(low, width, 0, len(values), len(odd))], _HEAD)
    return b"".join((head.tobytes(), np.packbits(bits, bitorder="little").tobytes(), odd.astype("<u2").tobytes(), rest[odd].astype("<u4").tobytes()))


def decode_block(raw: bytes | memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    """The values of the block at a place, and the place after it."""
    head = np.frombuffer(raw, _HEAD, 1, at)[0]
    n, width, odd = int(head["n"]), int(head["width"]), int(head["odd"])
    at += _HEAD.itemsize
    size = -(-n * width // 8)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :width] = bits
    values = np.packbits(padded, axis=1, bitorder="little").view("<u4")[:, 0].astype(np.uint32)
    at += size
    where = np.frombuffer(raw, "<u2", odd, at)
    values[where] = np.frombuffer(raw, "<u4", odd, at + 2 * odd)
    return values + np.uint32(head["low"]), at + 6 * odd


class ShardWriter:
    """One file, written front to back; documents may span blocks."""

    def __init__(self, sink, percentile: float):
        self.sink, self.percentile = sink, percentile
        self.rest, self.waiting = [], 0
        self.docs, self.starts, self.values, self.at = [], [], 0, 0
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, doc is None, len(ids)))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.concatenate(self.rest) if self.rest else np.zeros(0, np.int32)
        stop = len(values) if last else len(values) // BLOCK * BLOCK
        for a in range(0, stop, BLOCK):
            self.starts.append(self.at)
            self._put(encode_block(values[a : min(a + BLOCK, stop)], self.percentile))
        self.values += stop
        self.rest, self.waiting = [values[stop:]], len(values) - stop

    def close(self) -> tuple[int, int, int]:
        """(values, documents, bytes)."""
        self._flush(True)
        self._put(np.array(self.docs, _DOC).tobytes())
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(np.array([self.values, len(self.docs), len(self.starts)], "<u8").tobytes() + MAGIC)
        return self.values, len(self.docs), self.at


def read_shard(source) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, its first place in the file, IDs) in turn; source is a file that can be sought."""
    size = source.size()
    source.seek(size - _TAIL)
    tail = source.read(_TAIL)
    source.seek(0)
    if tail[-len(MAGIC) :] != MAGIC or source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a whole file of this format")
    _, n_docs, n_blocks = np.frombuffer(tail, "<u8", 3).tolist()
    source.seek(size - _TAIL - 8 * n_blocks - _DOC.itemsize * n_docs)
    table_at = source.tell()
    docs = np.frombuffer(source.read(_DOC.itemsize * n_docs), _DOC)
    starts = [*np.frombuffer(source.read(8 * n_blocks), "<u8").tolist(), table_at]
    held, have, block, place = [], 0, 0, 0
    for doc, null, n in docs.tolist():
        while have < n:
            upto = min(block + 64, n_blocks)
            source.seek(starts[block])
            raw = source.read(starts[upto] - starts[block])
            for b in range(block, upto):
                held.append(decode_block(raw, starts[b] - starts[block])[0])
                have += len(held[-1])
            block = upto
        values = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, np.uint32)
        yield None if null else doc, place, values[:n]
        held, have, place = [values[n:]], have - n, place + n


def write_token_files(docs: DataFrame, path: str, folder: str, *, end: int = 1, percentile: float = 95.0) -> DataFrame:
    """Writes the documents' IDs in ascending doc_id order to files in folder; returns a row for each file.

    Columns: part, file, n_values, n_docs, n_bytes, start (IDs in all files before it). folder is a URI of a file system
    that pyarrow opens. A file is written under a name of the attempt's own and then moved, so a task that is lost or
    runs twice leaves one whole file of the same content.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        temporary, name = f"{root}/_tmp-{part}-{uuid.uuid4().hex}", f"part-{part:06d}.pfor"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(temporary) as sink:
            writer = ShardWriter(sink, percentile)
            for ids, tokens in encoded(batches, path, end):
                for doc, x in zip(ids, tokens):
                    writer.add(doc, x)
            made = writer.close()
        store.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), *(pa.array([x]) for x in made)], ["part", "file", "n_values", "n_docs", "n_bytes"])

    manifest = checkpoint(ordered.mapInArrow(run, "part long, file string, n_values long, n_docs long, n_bytes long"))
    # a row for each file: as many as the shuffle has partitions
    rows, start = [], 0
    for r in manifest.orderBy("part").collect():
        rows.append((*r, start))
        start += r["n_values"]
    return docs.sparkSession.createDataFrame(rows, "part long, file string, n_values long, n_docs long, n_bytes long, start long")


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (IDs of all documents before it), n_tokens, ids (little-endian uint32) from the files."""
    files = manifest.where("n_docs > 0").select("part", "file", "start")
    files = files.repartitionByRange(max(1, manifest.count()), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    rows, size = [], 0
                    for doc, place, ids in read_shard(source):
                        rows.append((doc, row["start"] + place, len(ids), ids.astype("<u4").tobytes()))
                        size += 4 * len(ids)
                        if size > AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
