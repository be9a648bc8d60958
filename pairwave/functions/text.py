"""Scalar functions for identifiers, flags, names, dates and times; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = ("", "nan", "none", "nat", "null", "na")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null where it says nothing."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*BLANKS), t)


def identifier(c: Column) -> Column:
    """An identifier as text: ``123.0`` and ``1.23E+2`` become ``123``; blank becomes the empty string."""
    t = blank_to_null(c)
    whole = t.try_cast("double").cast("decimal(38,0)").cast("string")
    return F.coalesce(F.when(t.rlike(r"^\d+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).when(t.rlike(r"^[+]?\d+(\.\d+)?[eE][+]?\d+$"), whole).otherwise(t), F.lit(""))


def safe_name(c: Column, *, keep_dots: bool = False) -> Column:
    """A piece of a file name: other characters become ``_``; runs collapse unless dots are kept; blank becomes ``NA``."""
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^A-Za-z0-9_.\-]+" if keep_dots else r"[^A-Za-z0-9_\-]+", "_")
    t = t if keep_dots else F.regexp_replace(t, "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^_+|_+$", ""), F.lit("")), F.lit("NA"))


def truth(c: Column, *, numeric: bool = False) -> Column:
    """true/1/yes/y/t; with numeric any number but 0; anything else, null too, is false."""
    t = F.lower(F.trim(c.cast("string")))
    out = F.coalesce(t.isin("true", "1", "yes", "y", "t"), F.lit(False))
    return out | F.coalesce(t.try_cast("double") != 0, F.lit(False)) if numeric else out


def number(c: Column) -> Column:
    """A double, null where it can't be read or is not a number."""
    return F.nanvl(F.trim(c.cast("string")).try_cast("double"), F.lit(None).cast("double"))


def says_any(c: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words, in any case."""
    t, found = F.lower(F.coalesce(c, F.lit(""))), F.lit(False)
    for w in words:
        found = found | t.contains(w.lower())
    return found


def joined(*parts: Column, sep: str = " | ") -> Column:
    """The non-blank parts."""
    return F.array_join(F.array_compact(F.array(*[F.nullif(F.trim(p), F.lit("")) for p in parts])), sep)


def participant_cell(c: Column) -> Column:
    """``12, 3`` as (participant, suffix); a date cell holds them as month and year."""
    pair = r"(\d+)\s*,\s*(\d+)"
    day = c.try_cast("timestamp")
    from_text = c.rlike(pair)
    return F.struct(
        F.when(from_text, F.regexp_extract(c, pair, 1).try_cast("int")).otherwise(F.month(day)).alias("participant"),
        F.when(from_text, F.regexp_extract(c, pair, 2)).otherwise(F.year(day).cast("string")).alias("suffix"),
        F.lower(F.coalesce(c, F.lit(""))).contains("confed").alias("confederate"),
    )


def trial_conditions(order: Column) -> Column:
    """``ff-fe`` to the conditions of trials 1, 2, ...: each block twice."""
    blocks = F.filter(F.transform(F.split(order, "-"), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return F.flatten(F.transform(blocks, lambda x: F.array(x, x)))


def condition_of(order: Column, trial: Column) -> Column:
    return F.when(trial == 0, "practice").otherwise(F.coalesce(F.when(trial > 0, F.try_element_at(trial_conditions(order), trial.cast("int"))), F.lit("unknown")))


def dyad_id(a: Column, b: Column) -> Column:
    return F.format_string("P%02d_P%02d", a.cast("int"), b.cast("int"))


def segment_name(window: Column, trial: Column) -> Column:
    return F.format_string("cw%02d__trial%02d", window.cast("int"), trial.cast("int"))


def date_text(c: Column) -> Column:
    """``yyyy/MM/dd`` of what reads as a date, else the text as it is."""
    t = F.trim(c.cast("string"))
    day = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy")])
    return F.coalesce(F.date_format(day, "yyyy/MM/dd"), t)


def time_text(c: Column) -> Column:
    """``HH:mm`` of what reads as a time or a date with a time, blank for null, else the text as it is."""
    t = F.trim(c.cast("string"))
    formats = ("HH:mm:ss", "HH:mm", "H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "h:mm a")
    at = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])
    return F.coalesce(F.date_format(at, "HH:mm"), t, F.lit(""))


def folder_time(c: Column) -> Column:
    """The UTC instant in a session folder's name, in Unix seconds."""
    return F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyy_MM_dd-HH_mm_ss"))).cast("double")


def local_text(seconds: Column, zone: str) -> Column:
    """Unix seconds as local wall-clock text; blank for null."""
    at = F.timestamp_micros((seconds * 1_000_000).cast("long"))
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def wall_clock(c: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Local wall-clock text as Unix seconds."""
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(c, F.lit(pattern)), zone)).cast("double")


def minute_near(c: Column, anchor: Column) -> Column:
    """``mm:ss.s`` as Unix seconds in the hour that brings it nearest to an anchor; of two the earlier."""
    minutes, seconds = F.split_part(c, F.lit(":"), F.lit(1)).try_cast("double"), F.split_part(c, F.lit(":"), F.lit(2)).try_cast("double")
    base = F.floor(anchor / 3600) * 3600.0 + minutes * 60 + seconds
    tries = F.array(*[F.struct(F.abs(base + h * 3600.0 - anchor).alias("off"), F.lit(i).alias("i"), (base + h * 3600.0).alias("at")) for i, h in enumerate((-1, 0, 1))])
    return F.when(base.isNotNull(), F.array_min(tries)["at"])


def minute_at(c: Column, day: Column, hour: Column, zone: str) -> Column:
    """``mm:ss.s`` as Unix seconds on a given local date (``yyyy-MM-dd``) and hour."""
    minutes, seconds = F.split_part(c, F.lit(":"), F.lit(1)).try_cast("double"), F.split_part(c, F.lit(":"), F.lit(2)).try_cast("double")
    base = wall_clock(F.concat(day, F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00")), zone)
    return base + minutes * 60 + seconds


def clock_distance(hour: Column, minute: Column, at: Column) -> Column:
    """Seconds of day from a clock time that may lack its PM (hours 1 to 6) to a time of day; infinite if unknown."""
    literal = F.abs(hour * 3600.0 + minute * 60.0 - at)
    later = F.when(hour.between(1, 6), F.abs((hour + 12) * 3600.0 + minute * 60.0 - at))
    return F.coalesce(F.least(literal, later), F.lit(float("inf")))


def key_parts(path: Column) -> Column:
    """Folder and sensor of a file named ``folder__sensor__...``."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "__")
    return F.struct(F.get(parts, 0).alias("recording_folder"), F.get(parts, 1).alias("sensor_id"))


def sampling_rate(header: Column, from_times: Column) -> Column:
    """The last number of a title line, if from 20 to 1000 and within a tenth of the times' own rate, else that rate."""
    said = F.element_at(F.regexp_extract_all(header, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), -1).try_cast("double")
    fits = said.between(20, 1000)
    measured = F.when(from_times.between(20, 1000), from_times)
    return F.when(fits & (measured.isNull() | (F.abs(said - measured) <= 0.1 * measured)), said).otherwise(measured)


def reasons(*cases: tuple[Column, str], sep: str = "; ") -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in cases])), sep)
