"""From a sheet with two rows a session to the table of analysis units: a row for each window with its session, condition,
reasons against it and behaviour.

The sheet is folded by a scan in pieces, pairs are found by buckets, and the rest are equi-joins. All inputs may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import pairing, scan
from .quantiles import quantiles

# What a comment says for each flag, the reasons, the notes and the columns of the sheet.
COMMENT_FLAGS = {
    "ball_drop_flag": ["ball fell", "ball dropped", "ball drop", "bell fell"],
    "stopped_flag": ["stopped", "stoped", "almost stopped"],
    "talking_laughing_flag": ["talking", "talked", "laugh", "chit-chat", "chatted"],
    "wrong_way_flag": ["wrong way", "went over finish", "finish line"],
    "sensor_issue_comment_flag": ["sensor", "recording"],
}
EXCLUDING_FLAGS = ["ball_drop_flag", "stopped_flag", "wrong_way_flag"]
NO_METADATA = "No metadata match found."
SHEET = ["date", "time", "participant", "role", "trial_order", "comments", "ra"]
#: How far a mean of participants may lie from its pair's median.
PAIR_LIMIT = 0.6


def folded(rows: DataFrame, keys: list[str], place: str, opens: Column, span: int = 100_000) -> DataFrame:
    """keys, block (the first row's place), first and second (structs of all columns): rows taken two at a time.

    place numbers the rows of a key from 1 without gaps. A block begins at a row for which opens holds and takes the row after
    it, whatever that says; other rows before a block are passed over, and a last row without a next makes no block. After a
    row that doesn't open, block or not, the count starts anew, so that a row's part hangs on its distance from the last such
    row before it alone.
    """
    closed = F.when(~F.coalesce(opens, F.lit(False)), F.col(place))
    df = scan.pieces(rows, keys, place, span).withColumn("__closed", closed)
    df = scan.across(df, {"__own": F.max("__closed")}, {"__edge": lambda w: F.max("__own").over(scan.before(w))})
    seen = F.max("__closed").over(scan.before(scan.within(place)))
    second = (F.col(place) - F.coalesce(seen, "__edge", F.lit(0)) - 1) % 2 == 1
    df = df.withColumn("__second", second).where("__second or __closed is null")
    row = F.struct(*[F.col(c) for c in rows.columns])
    block = (F.col(place) - F.col("__second").cast("int")).alias("block")
    only = lambda s: F.max(F.when(F.col("__second") == s, row))
    out = df.groupBy(*keys, block).agg(only(False).alias("first"), only(True).alias("second"))
    return out.where("first is not null and second is not null")


def sessions(rows: DataFrame, keys: list[str], place: str, span: int = 100_000, brands: list[str] | None = None) -> DataFrame:
    """The sessions of a sheet (keys, place and the columns of SHEET): keys, block and what both rows say.

    A row opens a session if its trial order says something. Participants are cells like ``12, 3``. Of two rows with the same
    role the first has it. Flags come from both comments; a session is a pilot if a date is ``pilot`` or a comment says so.
    brands: more words of comments on the sensor, such as its maker's name.
    """
    flags = COMMENT_FLAGS | {"sensor_issue_comment_flag": COMMENT_FLAGS["sensor_issue_comment_flag"] + list(brands or [])}
    said = F.trim(F.col("trial_order").cast("string")) != ""
    df = folded(rows.select(*keys, place, *SHEET), keys, place, said, span)
    df = df.withColumns({f"__p{i}": text.participant_cell(F.col(f"{r}.participant").cast("string")) for i, r in ((1, "first"), (2, "second"))})
    one, two = F.col("__p1.participant"), F.col("__p2.participant")
    role = lambda r: F.upper(F.trim(F.coalesce(F.col(f"{r}.role").cast("string"), F.lit(""))))
    cell = lambda letter: F.when(role("first") == letter, F.col("__p1")).when(role("second") == letter, F.col("__p2"))
    a, b = cell("A"), cell("B")
    note = lambda r: F.coalesce(F.col(f"{r}.comments").cast("string"), F.lit(""))
    comments = text.joined(note("first"), note("second"))
    dated_pilot = lambda r: F.coalesce(F.lower(F.trim(F.col(f"{r}.date").cast("string"))) == "pilot", F.lit(False))
    pilot = dated_pilot("first") | dated_pilot("second") | text.says_any(note("first"), ["pilot"]) | text.says_any(note("second"), ["pilot"])
    suffix = lambda c: F.coalesce(c["suffix"], F.lit(""))
    sure = lambda c: F.coalesce(c["confederate"], F.lit(False))
    return df.select(
        *keys,
        "block",
        text.date_text(F.col("first.date")).alias("session_date"),
        text.time_text(F.col("first.time")).alias("session_time"),
        F.when(one.isNotNull() & two.isNotNull(), text.dyad_id(one, two)).otherwise("").alias("dyad_id"),
        one.alias("participant_1"),
        two.alias("participant_2"),
        ((F.coalesce(one, two) + F.coalesce(two, one)) / 2).alias("participant_mean"),
        F.array_join(F.array_sort(F.array(suffix(F.col("__p1")), suffix(F.col("__p2")))), ";").alias("sensor_suffix_set"),
        a["participant"].alias("participant_A"),
        b["participant"].alias("participant_B"),
        suffix(a).alias("sensor_A_suffix"),
        suffix(b).alias("sensor_B_suffix"),
        sure(a).alias("participant_A_is_confederate"),
        sure(b).alias("participant_B_is_confederate"),
        F.col("first.trial_order").alias("trial_order"),
        pilot.alias("is_pilot"),
        comments.alias("session_comments"),
        F.coalesce("first.ra", "second.ra").alias("ra"),
        *[text.says_any(comments, words).alias(name) for name, words in flags.items()],
    )


def with_pair(sessions: DataFrame, keys: list[str], behaviour: DataFrame, limit: float = PAIR_LIMIT) -> DataFrame:
    """sessions (keys name one) with pair1: the pair whose median participant mean is nearest to the session's, within limit.

    behaviour: pair1, trial, Participant_ID_mean; practice (trial 0 or less) counts only where there is nothing else. Of
    equals the least pair. A session without a participant, or with no pair so near, has none.
    """
    known = behaviour.where("Participant_ID_mean is not null and not isnan(Participant_ID_mean) and pair1 is not null")
    known = known.select("pair1", F.coalesce(F.col("trial") > 0, F.lit(False)).alias("__task"), "Participant_ID_mean")
    if known.where("__task").limit(1).count():
        known = known.where("__task")
    medians = quantiles(known, ["pair1"], ["Participant_ID_mean"], [0.5]).select("pair1", F.col("value").alias("__median"))
    asked = sessions.select(F.struct(*keys).alias("__key"), "participant_mean").where("participant_mean is not null")
    found = pairing.nearest(asked, medians, [], "participant_mean", "__median", limit, "pair1", "__key").select("__key", "pair1")
    return sessions.withColumn("__key", F.struct(*keys)).join(found, "__key", "left").drop("__key")


def analysis_units(windows: DataFrame, sessions: DataFrame, behaviour: DataFrame, folder: str = "recording_folder", *, comments_exclude: bool = False, pilots_exclude: bool = True) -> DataFrame:
    """windows (folder, trial, is_practice, usable_for_dyadic_ecg, window_duration_sec and more) as analysis units.

    sessions: one row a folder, as with_pair makes them; a window without one stays, with blank texts, false flags and a note.
    behaviour: pair1, trial, table_motion_mean, trial_duration_mean and more, joined on pair and trial; each of several rows
    makes a row, as in a left join, and a window without a pair has none. Its columns that stand already end in _aggregated.
    Adds condition, exclude_from_main_analysis, exclude_reason, folder_metadata_match_note, aggregated_data_missing and
    duration_difference_sec.
    """
    carried = [c for c in sessions.columns if c != folder and c not in windows.columns]
    kinds = {f.name: f.dataType.typeName() for f in sessions.schema}
    filler = {"string": "", "boolean": False}
    found = sessions.select(folder, *carried, F.lit(True).alias("__found"))
    df = windows.join(found, folder, "left")
    none = F.col("__found").isNull()
    filled = [F.when(none, F.lit(filler[kinds[c]])).otherwise(F.col(c)).alias(c) if kinds[c] in filler else F.col(c) for c in carried]
    note = F.when(none, NO_METADATA).otherwise("").alias("folder_metadata_match_note")
    df = df.select(*windows.columns, *filled, note)
    practice, usable = (F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("is_practice", "usable_for_dyadic_ecg"))
    condition = F.when(practice, "practice").otherwise(F.when(F.col("trial") > 0, text.condition_of(F.col("trial_order"), F.col("trial"))).otherwise("unknown"))
    df = df.withColumn("condition", F.coalesce(condition, F.lit("unknown")))
    noted = F.lit(False)
    for c in EXCLUDING_FLAGS:
        noted = noted | F.coalesce(F.col(c), F.lit(False))
    why = text.reasons(
        (practice, "practice"),
        (~usable, "not_usable_for_dyadic_ecg"),
        (F.lit(pilots_exclude) & F.coalesce(F.col("is_pilot"), F.lit(False)), "pilot"),
        (F.col("condition") == "unknown", "condition_unknown"),
        (F.lit(comments_exclude) & noted, "comment_flag_excluded"),
    )
    df = df.withColumn("exclude_reason", why).withColumn("exclude_from_main_analysis", F.col("exclude_reason") != "")
    taken = {c.lower() for c in df.columns}
    renamed = {c: f"{c}_aggregated" if c.lower() in taken else c for c in behaviour.columns if c not in ("pair1", "trial")}
    beside = behaviour.select("pair1", "trial", *[F.col(c).alias(n) for c, n in renamed.items()])
    df = df.join(beside, ["pair1", "trial"], "left")
    motion, lasted = renamed.get("table_motion_mean"), renamed.get("trial_duration_mean")
    missing = F.col(motion).isNull() if motion else F.lit(True)
    df = df.withColumn("aggregated_data_missing", missing)
    return df.withColumn("duration_difference_sec", F.col("window_duration_sec") - F.col(lasted)) if lasted else df


def unit_counts(units: DataFrame) -> DataFrame:
    """item, value: how many units there are, are eligible, excluded, of unknown condition, pilots, and without behaviour."""
    items = {
        "analysis_units_rows": F.lit(True),
        "candidate_windows_usable_for_dyadic_ecg": F.col("usable_for_dyadic_ecg"),
        "candidate_windows_not_usable_for_dyadic_ecg": ~F.coalesce(F.col("usable_for_dyadic_ecg"), F.lit(False)),
        "main_analysis_eligible_rows": ~F.col("exclude_from_main_analysis"),
        "main_analysis_excluded_rows": F.col("exclude_from_main_analysis"),
        "condition_unknown_rows": F.col("condition") == "unknown",
        "pilot_rows": F.col("is_pilot"),
        "aggregated_data_missing_rows": F.col("aggregated_data_missing"),
    }
    counts = units.agg(*[F.count_if(c).alias(n) for n, c in items.items()])
    pairs = ", ".join(f"'{n}', {n}" for n in items)
    return counts.selectExpr(f"stack({len(items)}, {pairs}) AS (item, value)")
