"""The sensor data source against a plain reader: titles, swapped columns, stretches of any length, odd bytes."""

import io
import math
import random

import pytest
from pyspark.errors import PySparkException

from pairwave.sources import files, sensor


def plain(data: bytes, time="Timestamp", value="Sample"):
    """(place, t, x) of a file, line by line."""
    lines, at = [], 0
    for raw in data.split(b"\n"):
        lines.append((at, raw.decode("utf-8", "replace")))
        at += len(raw) + 1
    names = [[n.strip().lstrip("﻿").strip('"').strip() for n in text.split(",")] for _, text in lines[:2]]
    for k in (1, 0):
        if k < len(names) and time in names[k] and value in names[k]:
            t, x = names[k].index(time), names[k].index(value)
            break
    out = []
    for place, text in lines[k + 1 :]:
        cells = [c.strip().strip('"').strip() for c in text.split(",")]
        try:
            row = float(cells[t]), float(cells[x])
        except (ValueError, IndexError):
            continue
        if "_" not in cells[t] + cells[x] and not any(map(math.isnan, row)):
            out.append((place, *row))
    return out


def made(rng):
    names = rng.choice([["Timestamp", "Sample"], ["Sample", "Timestamp"], ["note", " Sample ", "Timestamp"], ['"Timestamp"', "n", "Sample"]])
    head = rng.choice([["Sensor 7 at 128 Hz, left"], [""], ["Größe é"], []]) + [",".join(names)]
    cell = lambda: rng.choice([f"{rng.uniform(-1e6, 1e6)}", str(rng.randrange(99)), "", "bad", "nan", "-inf", '" 3.5 "', "+4e-3", "1_0", "é7", "1e999", ".5", "7.", "--1"])
    rows = [",".join(cell() for _ in range(rng.choice([len(names)] * 8 + [1, 5]))) for _ in range(rng.randrange(60))]
    end = rng.choice(["\n", "\r\n"])
    return (end.join(head + rows) + rng.choice(["", end, end + end])).encode()


def test_stretches_and_blocks_equal_a_plain_reader():
    """Each line is read once, whatever the lengths of stretches and blocks."""
    rng = random.Random(11)
    for _ in range(150):
        data, stretch, block = made(rng), rng.choice([1, 2, 7, 40, 333, 10_000]), rng.choice([1, 3, 16, 1000])
        got = []
        for s in range(0, len(data), stretch):
            file, end = io.BytesIO(data), min(s + stretch, len(data))
            _, _, begin, t, x = sensor.head(file, "Timestamp", "Sample")
            start = sensor.first_line(file, s, begin, rng.choice([1, 5, 64]))
            if start < end:
                for base, lines in sensor.blocks(file, start, end, block):
                    for place, a, b in zip(*sensor.numbers(lines, base, t, x)):
                        if a.is_valid and b.is_valid:
                            got.append((int(place), a.as_py(), b.as_py()))
        assert got == plain(data), data


def test_many_files(spark, tmp_path):
    rng, want = random.Random(5), []
    for i in range(12):
        folder = tmp_path / f"2024 {i % 3}" / str(i)
        folder.mkdir(parents=True)
        data = made(rng)
        (folder / "ECG.csv").write_bytes(data)
        (folder / "._ECG.csv").write_bytes(b"\x00\x05")
        want += [(i, *r) for r in plain(data)]
    (tmp_path / "empty.csv").write_text("")
    of = lambda r: int(r.file.split("/")[-2])
    for path in (str(tmp_path / "*" / "*" / "ECG.csv"), [str(tmp_path / f"2024 {k}") for k in range(3)], f"file://{tmp_path}/2024*"):
        for stretch in (64, 1 << 20):
            got = sensor.read(spark, path, stretch=stretch).collect()
            assert sorted((of(r), r.place, r.t, r.x) for r in got) == sorted(want)
    # the file is not among those with rows, but has a title's row
    assert sensor.read(spark, str(tmp_path), rows="titles").count() == 13
    assert sensor.read(spark, str(tmp_path / "empty.csv")).count() == 0
    assert sensor.read(spark, str(tmp_path / "none*")).count() == 0


def test_titles_read_the_first_bytes_only(spark, tmp_path):
    at = tmp_path / "a b.csv"
    at.write_text("Sensor 77 at 128 Hz\nSample,timestamp\n2,1.5\n")
    with at.open("r+b") as f:
        f.truncate(3 << 30)  # a hole, of which no byte is stored
    title = sensor.read(spark, str(at), rows="titles").first()
    assert (title.title, title["names"], title.bytes) == ("Sensor 77 at 128 Hz", ["Sample", "timestamp"], 3 << 30)
    at.write_text("Timestamp,Sample\n1,2\n")
    assert sensor.read(spark, str(at), rows="titles").first().title is None and files.titles(spark, str(at)).count() == 0
    got = files.sensor_csv(spark, str(at))
    assert got.columns == ["file", "place", "Timestamp", "Sample"] and tuple(got.first())[1:] == (17, 1.0, 2.0)


def test_faults_have_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text("title\na,b\n1,2\n")
    with pytest.raises(PySparkException, match="x.csv lacks Timestamp or Sample"):
        sensor.read(spark, str(tmp_path)).count()
    assert sensor.read(spark, str(tmp_path), time="A", value="b").first().x == 2.0
    with pytest.raises(PySparkException, match="nowhere"):
        sensor.read(spark, str(tmp_path / "nowhere")).count()
    with pytest.raises(PySparkException, match="rows is samples or titles"):
        sensor.read(spark, str(tmp_path), rows="x").count()
