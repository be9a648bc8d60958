"""Sheets folded two rows at a time, sessions, pairs and analysis units."""

import random

from pyspark.sql import functions as F

from pairwave.operators import units

SHEET = "k string, i long, date string, time string, participant string, role string, trial_order string, comments string, ra string"


def serial(said):
    """The plain loop: a row that opens takes the next one."""
    out, i = [], 0
    while i < len(said):
        if not said[i]:
            i += 1
        elif i + 1 == len(said):
            break
        else:
            out.append((i + 1, i + 2))
            i += 2
    return out


def test_folds_as_a_loop_does(spark):
    rng, rows, want = random.Random(3), [], []
    for k in [None, *map(str, range(40))]:
        said = [rng.random() < rng.choice([0.2, 0.6, 0.95]) for _ in range(rng.randrange(30))]
        rows += [(k, i + 1, "ff" if s else rng.choice([None, "", " "])) for i, s in enumerate(said)]
        want += [(k, a, b) for a, b in serial(said)]
    df = spark.createDataFrame(rows, "k string, i long, o string").repartition(5)
    for span in (1, 3, 100):
        got = units.folded(df, ["k"], "i", F.trim("o") != "", span)
        assert sorted(map(str, want)) == sorted(str((r.k, r.first["i"], r.second["i"])) for r in got.collect())
        assert all(r.block == r.first["i"] for r in got.collect())
    assert units.folded(df.where("false"), ["k"], "i", F.trim("o") != "").count() == 0


def sheet(spark):
    rows = [
        ("s", 1, "2024-05-06", "9:30", "3 , 11", "b", "ff-fe", "Ball dropped", None),
        ("s", 2, None, None, "4, 12", " A ", None, "PILOT run", "xy"),
        ("s", 3, "note", None, None, None, " ", None, None),
        ("s", 4, "2024-05-07", "10:00", "9, 1", "A", "fe", None, "ra"),
        ("s", 5, None, None, None, "A", "fe", None, None),
        ("s", 6, "2024-05-08", "11:00", "Confederate", "B", "ff", None, None),
        ("s", 7, None, None, "", None, None, "talked", None),
        ("s", 8, "2024-05-09", None, "5, 5", "A", "ff", None, None),
    ]
    return spark.createDataFrame(rows, SHEET)


def test_sessions(spark):
    got = {r.block: r for r in units.sessions(sheet(spark), ["k"], "i").collect()}
    assert sorted(got) == [1, 4, 6]
    one, four, six = got[1], got[4], got[6]
    assert (one.dyad_id, one.participant_A, one.participant_B, one.sensor_A_suffix, one.sensor_suffix_set) == ("P03_P04", 4, 3, "12", "11;12")
    assert one.is_pilot and one.ball_drop_flag and not one.stopped_flag and one.session_comments == "Ball dropped | PILOT run" and one.ra == "xy"
    assert (one.session_date, one.session_time, one.participant_mean) == ("2024/05/06", "09:30", 3.5)
    # a lone participant is the mean; of two rows with one role the first has it
    assert (four.dyad_id, four.participant_mean, four.participant_A, four.participant_B) == ("", 9.0, 9, None)
    assert not one.sensor_issue_comment_flag
    assert {r.block for r in units.sessions(sheet(spark), ["k"], "i", brands=["Talk"]).where("sensor_issue_comment_flag").collect()} == {6}
    assert six.participant_B is None and six.participant_B_is_confederate and six.talking_laughing_flag and six.participant_mean is None


def test_pairs_and_units(spark):
    made = units.sessions(sheet(spark), ["k"], "i")
    rows = [(1, 0, 99.0, 5.0, 60.0), (1, 1, 3.9, 7.0, 61.0), (1, 2, 3.9, None, 62.0), (2, 1, 3.1, 8.0, 63.0), (3, 1, 11.0, 1.0, 1.0), (None, 1, 9.0, 1.0, 1.0), (1, 1, 3.9, 9.0, 64.0)]
    behaviour = spark.createDataFrame(rows, "pair1 long, trial long, Participant_ID_mean double, table_motion_mean double, trial_duration_mean double").withColumn("RA", F.lit("theirs"))
    paired = units.with_pair(made, ["k", "block"], behaviour)
    # 3.5 lies as far from 3.1 as from 3.9: the least pair; 9 is too far from 11; practice doesn't count
    assert {r.block: r.pair1 for r in paired.collect()} == {1: 1, 4: None, 6: None}
    only = behaviour.where("trial = 0").withColumn("Participant_ID_mean", F.lit(9.2))
    assert {r.block: r.pair1 for r in units.with_pair(made, ["k", "block"], only).collect()}[4] == 1
    assert all(r.pair1 is None for r in units.with_pair(made, ["k", "block"], behaviour.where("false")).collect())

    windows = [("f1", 1, 0, True, True, 60.0), ("f1", 2, 1, False, True, 60.0), ("f1", 3, 2, False, None, 60.0), ("f1", 4, 9, False, True, 60.0), ("f4", 5, 1, False, True, 60.0), ("f9", 6, 1, False, True, None), (None, 7, None, None, True, 1.0)]
    windows = spark.createDataFrame(windows, "recording_folder string, candidate_window long, trial long, is_practice boolean, usable_for_dyadic_ecg boolean, window_duration_sec double")
    metadata = paired.withColumn("recording_folder", F.concat(F.lit("f"), "block")).drop("k", "block")
    out = units.analysis_units(windows, metadata, behaviour)
    got = {}
    for r in out.collect():
        got.setdefault(r.candidate_window, []).append(r)
    assert len(got[2]) == 2 and sorted(r.table_motion_mean for r in got[2]) == [7.0, 9.0]
    assert {k: (v[0].condition, v[0].exclude_reason) for k, v in got.items()} == {
        1: ("practice", "practice; pilot"),
        2: ("FF", "pilot"),
        3: ("FF", "not_usable_for_dyadic_ecg; pilot"),
        4: ("unknown", "pilot; condition_unknown"),
        5: ("FE", ""),
        6: ("unknown", "condition_unknown"),
        7: ("unknown", "condition_unknown"),
    }
    assert got[6][0].folder_metadata_match_note == units.NO_METADATA and got[6][0].dyad_id == "" and got[6][0].is_pilot is False
    assert got[3][0].aggregated_data_missing and got[3][0].duration_difference_sec == -2.0 and got[5][0].aggregated_data_missing
    # a column of behaviour that stands already ends in _aggregated, in any case of its letters
    assert got[2][0].RA_aggregated == "theirs" and got[2][0].ra == "xy"
    noted = units.analysis_units(windows, metadata, behaviour, comments_exclude=True, pilots_exclude=False).where("candidate_window = 2").first()
    assert noted.exclude_reason == "comment_flag_excluded" and noted.exclude_from_main_analysis
    counts = {r.item: r.value for r in units.unit_counts(out).collect()}
    assert counts["analysis_units_rows"] == 8 and counts["main_analysis_eligible_rows"] == 1 and counts["condition_unknown_rows"] == 3
    assert units.analysis_units(windows.where("false"), metadata, behaviour).count() == 0
    assert units.analysis_units(windows, metadata.where("false"), behaviour.where("false")).count() == 7
