"""The data source ``sensor_csv``: recordings with a free-text title in line 1 and a header in line 2, or the header in line 1.

    spark.dataSource.register(sensor.SensorCsv)
    spark.read.format("sensor_csv").load("/study/*/ECG.csv")                            # file, place, t, x
    spark.read.format("sensor_csv").option("rows", "titles").load("/study")             # file, title, names, bytes

A partition is a stretch of a file. Its task reads title and header off the file's first bytes, so that columns are found by
name in each file, whatever their order there, and then its own stretch in blocks; a line belongs to the stretch that it
begins in. So one long recording is spread over tasks, each holds a block at a time, and titles read no more than the first
bytes. place is the byte at which a row's line begins: rows in order of place are in file order, however they were read.

Options: path (files, folders or patterns, on any file system that pyarrow opens; or ``paths``, a JSON list of them), ``time``
and ``value`` (column names, ``Timestamp`` and ``Sample``: exactly, else in any case), ``rows`` (``samples`` or ``titles``),
``stretch`` (bytes of a partition).

Rows without two numbers are left out, among them damaged lines; NaN counts as none. Bytes beyond ASCII are never part of a
number. Empty files have no rows and a null title. A file that has lines but lacks a column is an error that names it. Hidden
files (names that begin with . or _) are passed over. Quoted fields may not hold line ends or commas.
A path without a scheme is local.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STRETCH = 64 << 20
BLOCK = 4 << 20
#: Bytes in which title and header must end.
HEAD = 64 << 10
NUMBER = r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity))$"


@dataclass
class Stretch(InputPartition):
    """Bytes start to end of a file, or a list of whole files for their titles."""

    files: list[tuple[str, int]]
    start: int = 0
    end: int = 0


def _open(uri: str):
    store, at = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))
    return store, at


def listed(path: str) -> list[tuple[str, int]]:
    """The files that a path means (a file, a folder with all below it, or a pattern), with their bytes, by name."""
    fixed = path
    while re.search(r"[*?\[]", fixed):
        fixed = fixed.rstrip("/").rpartition("/")[0]
    if path != fixed and not fixed:
        fixed = "/" if path.startswith("/") else "."
    store, root = _open(fixed)
    prefix = fixed.partition("://")[0] + "://" if "://" in fixed else ""
    # the authority of a URI, which its file system leaves out of names
    host = re.match(r"[^/]*", fixed.partition("://")[2]).group() if prefix and not root.startswith(fixed.partition("://")[2]) else ""
    info = store.get_file_info(root)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pyarrow.fs.FileType.File:
        found = [info]
    else:
        found = [f for f in store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.type == pyarrow.fs.FileType.File]
    if path != fixed:
        wanted = (root.rstrip("/") + path[len(fixed.rstrip("/")) :] if fixed != "." else f"{root}/{path}").rstrip("/").split("/")
        meets = lambda name: len(name) >= len(wanted) and all(fnmatch.fnmatchcase(n, w) for n, w in zip(name, wanted))
        found = [f for f in found if meets(f.path.split("/"))]
    shown = [f for f in found if not any(p.startswith((".", "_")) for p in f.path[len(root) :].split("/")) and not f.base_name.startswith((".", "_"))]
    return sorted((f"{prefix or 'file://'}{host}{quote(f.path)}", f.size) for f in shown)


def head(file, time: str, value: str) -> tuple[str | None, list[str], int, int | None, int | None]:
    """Title (null where line 1 is the header or the file is empty), names, the byte the rows begin at, the places of two columns."""
    lines, at = [], 0
    data = file.read(HEAD)
    for raw in data.split(b"\n")[:2]:
        at += len(raw) + 1
        lines.append((raw.decode("utf-8-sig", "replace").rstrip("\r"), min(at, len(data))))
    named = [([n.strip().strip('"').strip() for n in text.split(",")], begin) for text, begin in lines]
    # line 2 first: a title may say anything
    for names, begin in reversed(named):
        t, x = place_of(names, time), place_of(names, value)
        if t is not None and x is not None:
            title = None if (names, begin) == named[0] else lines[0][0]
            return title, names, begin, t, x
    return (lines[0][0] if data else None), [], len(data), None, None


def place_of(names: list[str], name: str) -> int | None:
    if name in names:
        return names.index(name)
    lower = [n.lower() for n in names]
    return lower.index(name.lower()) if name.lower() in lower else None


def blocks(file, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, whole lines) of the lines that begin from start to before end."""
    file.seek(start)
    kept, at = [], start
    while at < end or kept:
        data = file.read(size)
        if not data:
            break
        # lines that begin before the end: up to the first line end at or after end - 1
        last = -1
        if at + len(data) >= end:
            last = data.find(b"\n", max(end - 1 - at, 0))
            cut = last if last >= 0 else -1
        else:
            cut = data.rfind(b"\n")
        if cut < 0:
            kept.append(data)
        else:
            whole = b"".join([*kept, data[: cut + 1]])
            yield at + cut + 1 - len(whole), whole
            kept = [data[cut + 1 :]] if last < 0 and cut + 1 < len(data) else []
            if last >= 0:
                return
        at += len(data)
    if kept:
        whole = b"".join(kept)
        yield at - len(whole), whole


def first_line(file, start: int, begin: int, size: int = 64 << 10) -> int:
    """The first byte from start on at which a line begins, rows beginning at begin."""
    if start <= begin:
        return begin
    file.seek(start - 1)
    at = start - 1
    while data := file.read(size):
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return at


def numbers(data: bytes, base: int, t: int, x: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The bytes at which lines begin, and two columns of numbers with nulls, of a block of whole lines."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if raw.max(initial=0) > 127:
        raw = np.where(raw > 127, np.uint8(ord("?")), raw)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends + 1)).astype(np.int64)
    edges = np.append(starts[starts < len(raw)], len(raw)).astype(np.int64)
    lines = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.tobytes()), pa.py_buffer(raw.tobytes()))
    cells = pc.split_pattern(lines, ",")
    flat = cells.flatten()
    offsets = cells.offsets.to_numpy() - cells.offsets[0].as_py()

    def column(k: int) -> pa.Array:
        place = offsets[:-1] + k
        cell = flat.take(pa.array(place, mask=place >= offsets[1:]))
        cell = pc.utf8_trim(pc.utf8_trim(cell, " \t\r\n"), '" ')
        good = pc.match_substring_regex(cell, NUMBER)
        cell = pc.utf8_ltrim(pc.if_else(good, cell, pa.scalar(None, pa.large_string())), "+")
        try:
            return pc.cast(cell, pa.float64())
        except pa.ArrowInvalid:
            # numbers beyond the range of doubles
            return pa.array([None if c is None else float(c) for c in cell.to_pylist()], pa.float64())

    return edges[:-1] + base, column(t), column(x)


class SensorCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sensor_csv"

    def _titles(self) -> bool:
        rows = self.options.get("rows", "samples")
        if rows not in ("samples", "titles"):
            raise ValueError(f"rows is samples or titles, not {rows}")
        return rows == "titles"

    def schema(self) -> str:
        return "file string, title string, names array<string>, bytes long" if self._titles() else "file string, place long, t double, x double"

    def reader(self, schema) -> DataSourceReader:
        return SensorReader(self.options, self._titles())


class SensorReader(DataSourceReader):
    def __init__(self, options, titles: bool):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.time, self.value = options.get("time", "Timestamp"), options.get("value", "Sample")
        self.stretch, self.titles = int(options.get("stretch", STRETCH)), titles
        if self.stretch < 1:
            raise ValueError("a stretch has at least one byte")

    def partitions(self) -> list[Stretch]:
        files = sorted({f for p in self.paths for f in listed(p)})
        if self.titles:
            many = 64
            return [Stretch(files[i : i + many]) for i in range(0, len(files), many)] or [Stretch([])]
        cut = [Stretch([(f, n)], s, min(s + self.stretch, n)) for f, n in files for s in range(0, n, self.stretch)]
        return cut or [Stretch([])]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        return self._heads(part) if self.titles else self._rows(part)

    def _heads(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        rows = []
        for uri, size in part.files:
            store, at = _open(uri)
            with store.open_input_file(at) as file:
                title, names, *_ = head(file, self.time, self.value)
            rows.append({"file": uri, "title": title, "names": names, "bytes": size})
        kind = pa.schema([("file", pa.string()), ("title", pa.string()), ("names", pa.list_(pa.string())), ("bytes", pa.int64())])
        yield pa.RecordBatch.from_pylist(rows, kind)

    def _rows(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        for uri, _ in part.files:
            store, at = _open(uri)
            with store.open_input_file(at) as file:
                _, names, begin, t, x = head(file, self.time, self.value)
                if t is None:
                    raise ValueError(f"{uri} lacks {self.time} or {self.value} in its first two lines")
                start = first_line(file, part.start, begin)
                if start >= part.end:
                    return
                for base, data in blocks(file, start, part.end, BLOCK):
                    place, ts, xs = numbers(data, base, t, x)
                    keep = pc.and_(pc.is_valid(ts), pc.is_valid(xs))
                    many = pc.sum(keep).as_py() or 0
                    columns = [pa.array([uri] * many, pa.string()), *(c.filter(keep) for c in (pa.array(place, pa.int64()), ts, xs))]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "place", "t", "x"])


def read(spark: SparkSession, paths: str | list[str], **options):
    """The data source's table of one path or several; options as above."""
    spark.dataSource.register(SensorCsv)
    paths = [paths] if isinstance(paths, str) else list(paths)
    named = {"paths": json.dumps([p if re.match(r"[A-Za-z][\w+.-]*:", p) else os.path.abspath(p) for p in paths])}
    return spark.read.format("sensor_csv").options(**named, **{k: str(v) for k, v in options.items()}).load()
