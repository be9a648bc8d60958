"""The log of runs: stopped at any step, done again, or meeting another run, every segment stands once."""

import pytest

from pairwave.operators import storage
from pairwave.sources import files, runs


def rows(spark, *keys):
    return spark.createDataFrame([(k, w, float(i)) for k, w in keys for i in range(3)], "k string, w long, x double")


FIRST, BOTH = [("a", 1), (None, 2)], [("a", 1), (None, 2), ("a", None), ("", 3)]


def stands_once(log, keys):
    got = {}
    for r in log.segments().collect():
        got[r.k, r.w] = got.get((r.k, r.w), 0) + 1
    return got == dict.fromkeys(keys, 3)


def test_runs_and_their_status(spark, tmp_path):
    log = runs.RunLog(spark, f"file://{tmp_path}/log", ["k", "w"])
    assert log.segments() is None and log.status().count() == 0 and {r["item"]: r["n"] for r in log.summary().collect()}["runs"] == 0
    assert log.write("one", rows(spark, *FIRST), {"fs": 4}) and not log.write("one", rows(spark, *BOTH))
    assert log.write("two", rows(spark, *BOTH)) and stands_once(log, BOTH)
    status = {(r.run, r.k, r.w): (r.status, r.n_rows) for r in log.status().collect()}
    assert status["one", None, 2] == ("saved", 3) and status["two", None, 2] == ("skipped_existing_file", 3) and status["two", "", 3] == ("saved", 3)
    told = {(r["item"], r["value"]): r["n"] for r in log.summary().collect()}
    assert told["runs", None] == 2 and told["segments", None] == 4 and told["rows", None] == 12 and told["elapsed_sec", None] > 0
    assert told["status", "saved"] == 4 and told["status", "skipped_existing_file"] == 2
    log.write_summary()
    assert spark.read.json(f"{tmp_path}/log/summary").count() == 6
    first = log.entries().orderBy("number").first()
    assert (first.run, first.parameters, first.segments) == ("one", '{"fs": 4}', 2) and first.ended >= first.started


@pytest.mark.parametrize("step", ["before data", "after data", "before the entry", "in the rename"])
def test_a_run_that_dies_is_done_again(spark, tmp_path, monkeypatch, step):
    log = runs.RunLog(spark, f"file://{tmp_path}/log", ["k", "w"])
    log.write("one", rows(spark, *FIRST))

    class Died(Exception):
        pass

    def dies(*a, **b):
        raise Died

    with monkeypatch.context() as m:
        if step == "before data":
            m.setattr(runs.RunLog, "_read", dies)
        elif step == "after data":
            m.setattr(runs.time, "time", lambda seen=[]: seen.append(1) or (dies() if len(seen) > 1 else 1.0))
        elif step == "before the entry":
            m.setattr(runs, "enter", dies)
        else:
            store, real = [], storage._path
            m.setattr(storage, "_path", lambda s, at: store.append(at) or (real(s, at) if "/." not in at else dies()))
        with pytest.raises(Died):
            log.write("two", rows(spark, *BOTH))
    assert stands_once(log, FIRST)
    assert log.write("two", rows(spark, *BOTH)) and stands_once(log, BOTH)


def test_two_runs_at_once(spark, tmp_path, monkeypatch):
    log = runs.RunLog(spark, f"file://{tmp_path}/log", ["k", "w"])
    other = runs.RunLog(spark, f"file://{tmp_path}/log", ["k", "w"])
    real, met = runs.enter, []

    def late(*a):
        if not met:
            met.append(1)
            assert other.write("other", rows(spark, *FIRST))
        return real(*a)

    monkeypatch.setattr(runs, "enter", late)
    assert log.write("mine", rows(spark, *BOTH)) and stands_once(log, BOTH)
    assert [r.run for r in log.entries().orderBy("number").collect()] == ["other", "mine"]


def test_segments_with_null_keys_are_written_once(spark, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        files.write_new_segments(rows(spark, *BOTH), out, ["k", "w"])
    assert spark.read.csv(out, header=True).count() == 12
    again = {(r.k, r.w): r.status for r in files.write_new_segments(rows(spark, *BOTH, ("b", 9)), out, ["k", "w"]).collect()}
    assert again.pop(("b", "9")) == "saved" and set(again.values()) == {"skipped_existing_file"}


def test_a_manifest_s_run_replaces_its_own_rows(spark, tmp_path):
    made = spark.createDataFrame([("0.csv", "success", 5, "")], "file string, status string, n_rows long, error string")
    for run in ("r1", "r1", "r2"):
        files.append_manifest(made, str(tmp_path / "m"), run)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
