"""Cleaning: missing values, key/row deletion, parsing, trimming, durations.

Two cleaning profiles reproduce the two specifications of the reference:

* ``SQL`` - delete **by key** (every row sharing a ``ride_id`` with a bad row
  goes; a NULL ``ride_id`` is never matched), trim spaces, whole minutes.
* ``R``   - drop **by row**, trim all whitespace, title case, fractional minutes.

Plan shape. Row mode is one narrow stage (scan -> project -> filter), no
shuffle. Key mode shuffles ids, not trips: one pass groups (id, flagged) and
finds the *contested* ids, those of a flagged and of a kept row. A bitmap of
their hashes (fixed size, ``operators.sketch``) splits the trips in one
filter: a row whose id is surely not contested stays or goes by its own flag;
only the candidates are written aside and decided by an exact anti join. NULL
ids match nothing and pass by. The plan is the same at every size.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.functions.columns import across, is_string, rename
from tripmart.functions.text import (
    blank_to_null,
    is_missing,
    replace_text,
    squish_spaces,
    strip_whitespace,
    title_case,
    trim_spaces,
)
from tripmart.functions.time import day_name, minutes_between, minutes_fractional, parse_mdy_hm, parse_timestamp
from tripmart.operators.audit import Metrics, changed, observed, report
from tripmart.operators.sketch import hash_bitmap
from tripmart.schema import COORD_COLUMNS, RAW_SCHEMA, RENAMES, TEXT_FIXES
from tripmart.session import materialize
from tripmart.sources.csv import clipped

KEY = "ride_id"
TIME_COLUMNS = ("started_at", "ended_at")
TITLE_COLUMNS = ("bike_type", "start_sta_name", "end_sta_name", "user_type")
STATION_COLUMNS = ("start_sta_name", "end_sta_name")


@dataclass(frozen=True)
class Profile:
    mode: str = "row"  # "key" (delete every row of a bad key) or "row"
    trim: str = "spaces"  # "spaces" (SQL TRIM) or "whitespace" (all kinds)
    title: bool = False  # title-case bike type, station names, user type
    fractional: bool = False  # ride_length as DOUBLE minutes instead of BIGINT
    fix_text: bool = False  # literal text fixes (TEXT_FIXES)
    squish: bool = False  # collapse runs of inner spaces
    clip: bool = False  # coordinates as the declared decimal, out of range the nearest bound
    min_minutes: int = 1
    marks: tuple[str, ...] = ()  # texts that mean a missing value, besides the empty one
    mdy: bool = False  # timestamps with any separators, whole text (else "/", " ", ":" and any rest)

    def with_(self, **kw) -> Profile:
        return replace(self, **kw)


SQL = Profile(mode="key", trim="spaces", clip=True)
R = Profile(mode="row", trim="whitespace", title=True, fractional=True, marks=("NA",), mdy=True)


# --- predicates ---------------------------------------------------------------


def missing_predicate(df: DataFrame, columns=None, marks=()) -> Column:
    """One OR-reduced test over all (or the given) columns: text is missing
    when NULL, empty or one of ``marks``, anything else when NULL. One scan, not
    one per column."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    tests = [is_missing(f.name, isinstance(f.dataType, T.StringType)) for f in fields]
    tests += [F.coalesce(F.col(f.name) == m, F.lit(False)) for f in fields if isinstance(f.dataType, T.StringType) for m in marks]
    return reduce(lambda a, b: a | b, tests)


def missing_columns(df: DataFrame, columns=None) -> Column:
    """Array of the names of the columns that are missing in this row."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    flags = [
        F.when(is_missing(f.name, isinstance(f.dataType, T.StringType)), F.lit(f.name))
        for f in fields
    ]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


# --- key deletion ---------------------------------------------------------------


def contested(ids: DataFrame) -> DataFrame:
    """``_k`` of the ids (``_k, _bad``; one row per trip) that both a bad and a
    good row own: one group-by of the ids alone, combined before the shuffle."""
    seen = ids.where(F.col("_k").isNotNull()).groupBy("_k").agg(F.max("_bad").alias("_some"), F.min("_bad").alias("_all"))
    return seen.where(F.col("_some") & ~F.col("_all")).select("_k")


def _split(df: DataFrame, key: Column, twice: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` without the candidate rows for an id of ``twice``, and those rows,
    written aside. NULL ids are never candidates."""
    holds = hash_bitmap(twice.select(F.xxhash64("_k").alias("_h")))
    candidate = key.isNotNull() & holds(F.xxhash64(key))
    return df.where(~candidate), materialize(df.where(candidate), "candidates")


def delete_by_key(df: DataFrame, flagged: Column, key: str = KEY) -> DataFrame:
    """``DELETE FROM df WHERE key IN (SELECT key FROM df WHERE flagged)``.

    A NULL key is never deleted (``NULL IN (...)`` is not true); a NULL
    ``flagged`` does not flag."""
    k = F.col(key)
    flag = F.coalesce(flagged, F.lit(False))
    twice = materialize(contested(df.select(k.alias("_k"), flag.alias("_bad"))), "contested")
    sure, candidates = _split(df.where(k.isNull() | ~flag), k, twice)
    return sure.unionByName(candidates.join(twice, candidates[key] == twice["_k"], "left_anti"))


def anti_join(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``keys``; NULL keys survive."""
    k = F.col(key)
    own, bad = (d.select(k.alias("_k"), F.lit(x).alias("_bad")) for d, x in ((df, False), (keys, True)))
    twice = materialize(contested(own.unionByName(bad)), "contested")
    sure, candidates = _split(df, k, twice)
    return sure.unionByName(candidates.join(twice, candidates[key] == twice["_k"], "left_anti"))


# --- cleaning steps -------------------------------------------------------------


def rename_raw(raw: DataFrame) -> DataFrame:
    return rename(raw, RENAMES)


def clip_coordinates(df: DataFrame) -> DataFrame:
    """Coordinates that are not decimals yet as the declared decimal, clipped."""
    own = [f.name for f in df.schema.fields if f.name in COORD_COLUMNS and not isinstance(f.dataType, T.DecimalType)]
    return clipped(df, T.StructType([f for f in RAW_SCHEMA.fields if f.name in own]))


def drop_missing(df: DataFrame, mode: str = "row", key: str = KEY, marks=()) -> DataFrame:
    """Remove rows with a missing value (row mode), or every row whose key
    has a row with a missing value (key mode)."""
    pred = missing_predicate(df, marks=marks)
    if mode == "row":
        return df.filter(~pred)
    return delete_by_key(df, pred, key)


def blanks_to_null(df: DataFrame, marks=()) -> DataFrame:
    """Empty text, and text equal to one of ``marks``, to NULL."""
    def step(c):
        out = blank_to_null(c)
        for m in marks:
            out = F.nullif(out, F.lit(m))
        return out

    return across(df, is_string, step)


def parse_times(df: DataFrame, columns=TIME_COLUMNS, parse=parse_timestamp) -> DataFrame:
    """Text timestamps -> TIMESTAMP_NTZ in place (same names, same positions).
    Both come out of one generated row, so every later use (a duration in a filter
    and in the output) reads the parsed value; Catalyst would otherwise push the
    filter down with a second copy of the parsers."""
    own = [c for c in columns if c in df.columns]
    if not own:
        return df
    once = F.inline(F.array(F.struct(*[parse(c).alias(c) for c in own])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in own], once).select(*[F.col(f"`{c}`") for c in df.columns])


def trim_text(df: DataFrame, how: str = "spaces") -> DataFrame:
    fn = trim_spaces if how == "spaces" else strip_whitespace
    return across(df, is_string, fn)


def polish_text(df: DataFrame, profile: Profile) -> DataFrame:
    if profile.title:
        df = across(df, [c for c in TITLE_COLUMNS if c in df.columns], title_case)
    if profile.fix_text:
        df = across(df, is_string, lambda c: replace_text(c, TEXT_FIXES))
    if profile.squish:
        df = across(df, is_string, squish_spaces)
    return df


def duration_expr(fractional: bool = False) -> Column:
    fn = minutes_fractional if fractional else minutes_between
    return fn("started_at", "ended_at")


def add_duration(df: DataFrame, fractional: bool = False) -> DataFrame:
    """``ride_length`` (minutes) and ``day_of_week`` (full weekday name)."""
    return df.withColumns(
        {"ride_length": duration_expr(fractional), "day_of_week": day_name("started_at")}
    )


def min_duration(df: DataFrame, mode: str = "row", minutes: int = 1, key: str = KEY, fractional: bool = False) -> DataFrame:
    """Row mode keeps ``ride_length >= minutes`` (NULL dropped). Key mode
    deletes every row of a key that has a ride shorter than ``minutes``
    (a NULL duration flags nothing)."""
    dur = duration_expr(fractional)
    if mode == "row":
        return df.filter(dur >= F.lit(minutes))
    return delete_by_key(df, dur < F.lit(minutes), key)


# --- whole pipelines --------------------------------------------------------------


def sql_stage_parsed(raw: DataFrame) -> DataFrame:
    """SQL order up to the duplicate check: rename -> delete missing by key -> parse."""
    df = clip_coordinates(rename_raw(raw))
    return parse_times(delete_by_key(df, missing_predicate(df), KEY))


def parser(p: Profile):
    return parse_mdy_hm if p.mdy else parse_timestamp


def r_stage_parsed(raw: DataFrame) -> DataFrame:
    """R order up to the duplicate check: rename -> blank to NA -> drop NA -> parse."""
    df = blanks_to_null(rename_raw(raw), R.marks)
    return parse_times(df.na.drop("any"), parse=parse_mdy_hm)


def _key_flags(raw: DataFrame, p: Profile) -> DataFrame:
    """The parsed trips with ``_miss``, the trimmed id ``_tid`` and ``_short``."""
    df = rename_raw(raw)
    if p.clip:
        df = clip_coordinates(df)
    fn = trim_spaces if p.trim == "spaces" else strip_whitespace
    # the missing test reads the raw text, so it is taken before parsing
    df = parse_times(df.withColumns({"_miss": missing_predicate(df, marks=p.marks)}), parse=parser(p))
    return df.withColumns({"_tid": fn(F.col(KEY)), "_short": F.coalesce(duration_expr(p.fractional) < F.lit(p.min_minutes), F.lit(False))})


def _delete_in_turn(df: DataFrame) -> DataFrame:
    """Both deletes, one after the other, over rows that hold all rows of
    their trimmed ids: (1) raw ids of rows with a missing value; (2) trimmed
    ids of what is left that is too short."""
    bad = df.where("_miss").select(F.col(KEY).alias("_k")).distinct()
    left = df.where(~F.col("_miss")).join(bad, F.col(KEY) == F.col("_k"), "left_anti")
    short = left.where("_short").select(F.col("_tid").alias("_k")).distinct()
    return left.where(~F.col("_short")).join(short, F.col("_tid") == F.col("_k"), "left_anti")


def _left_by_key(raw: DataFrame, p: Profile) -> DataFrame:
    """Key mode: the trips that stay, not trimmed yet. Both deletes act inside one
    trimmed id, so only trimmed ids of a flagged and of a kept row need more than the
    row's own flags; their rows (flagged ones too) are the candidates, decided in turn."""
    df = _key_flags(raw, p)
    flagged = F.col("_miss") | F.col("_short")
    twice = contested(df.select(F.col("_tid").alias("_k"), flagged.alias("_bad")))
    sure, candidates = _split(df, F.col("_tid"), twice)
    out = sure.where(F.col("_tid").isNull() | ~flagged).unionByName(_delete_in_turn(candidates))
    return out.drop("_miss", "_short", "_tid")


def _left_by_row(raw: DataFrame, p: Profile) -> DataFrame:
    """Row mode: the trips without a missing value, parsed, not trimmed yet; those
    too short are still there."""
    df = rename_raw(raw)
    if p.clip:
        df = clip_coordinates(df)
    return parse_times(drop_missing(df, "row", marks=p.marks), parse=parser(p))


def text_metrics(df: DataFrame, p: Profile) -> Metrics:
    """How many values each text step changes, by step and column, in the trips that
    stay; and how many timestamps no pattern reads."""
    stays = F.lit(True) if p.mode == "key" else F.coalesce(duration_expr(p.fractional) >= F.lit(p.min_minutes), F.lit(False))
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    steps = [("trim", trim_spaces if p.trim == "spaces" else strip_whitespace, text)]
    if p.title:
        steps.append(("title_case", title_case, [c for c in TITLE_COLUMNS if c in text]))
    if p.fix_text:
        steps.append(("fix_text", lambda c: replace_text(c, TEXT_FIXES), text))
    if p.squish:
        steps.append(("squish", squish_spaces, text))
    out = {("unread", c): F.count_if(F.col(c).isNull()) for c in TIME_COLUMNS if c in df.columns}
    now = {c: F.col(c) for c in text}
    for name, fn, columns in steps:
        for c in columns:
            then = fn(now[c])
            out[name, c] = changed(now[c], then, stays)
            now[c] = then
    return out


def value_audit(raw: DataFrame, profile: Profile = R) -> DataFrame:
    """``step, column_name, changed`` of a cleaning, in one global aggregate."""
    left = (_left_by_key if profile.mode == "key" else _left_by_row)(raw, profile)
    return report(left, text_metrics(left, profile))


def key_clean_audit(raw: DataFrame, profile: Profile = SQL) -> DataFrame:
    """``(step_no, step, rows_in, rows_out)`` of the key-mode chain without a
    join: rows are counted per raw id, raw ids per trimmed id, then all."""
    df = _key_flags(raw, profile)
    no_id = F.col(KEY).isNull()
    per_id = df.groupBy(KEY, "_tid").agg(F.count(F.lit(1)).alias("n"), F.max("_miss").alias("m"), F.max("_short").alias("s"))
    left = F.when(no_id | ~F.col("m"), F.col("n")).otherwise(0)
    per_tid = per_id.groupBy("_tid").agg(
        F.sum("n").alias("n0"), F.sum(left).alias("n1"), F.max(~no_id & ~F.col("m") & F.col("s")).alias("gone")
    )
    counts = per_tid.agg(
        F.coalesce(F.sum("n0"), F.lit(0)).alias("n0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"),
        F.coalesce(F.sum(F.when(F.col("gone"), 0).otherwise(F.col("n1"))), F.lit(0)).alias("n2"),
    )
    steps = [("rename", "n0", "n0"), ("delete_missing", "n0", "n1"), ("parse", "n1", "n1"), ("trim", "n1", "n1"), ("delete_short", "n1", "n2")]
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"), F.col(a).alias("rows_in"), F.col(b).alias("rows_out"))
        for i, (name, a, b) in enumerate(steps)
    ])
    return counts.select(F.inline(rows))


def row_clean_audit(raw: DataFrame, profile: Profile = R) -> DataFrame:
    """Row-mode chain audit in one pass (one global aggregate)."""
    df = rename_raw(raw)
    keep1 = ~missing_predicate(df, marks=profile.marks)
    dur = F.coalesce(duration_expr(profile.fractional) >= F.lit(profile.min_minutes), F.lit(False))
    parsed = parse_times(df.withColumn("_keep1", keep1), parse=parser(profile))
    counts = parsed.agg(
        F.count(F.lit(1)).alias("n0"),
        F.count_if(F.col("_keep1")).alias("n1"),
        F.count_if(F.col("_keep1") & dur).alias("n2"),
    )
    steps = [("rename", "n0", "n0"), ("drop_missing", "n0", "n1"), ("parse", "n1", "n1"), ("trim", "n1", "n1"), ("min_duration", "n1", "n2")]
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"), F.col(a).alias("rows_in"), F.col(b).alias("rows_out"))
        for i, (name, a, b) in enumerate(steps)
    ])
    return counts.select(F.inline(rows))


def clean_trips(raw: DataFrame, profile: Profile = R, audit: Observation | None = None) -> DataFrame:
    """Raw trips -> cleaned trips with ``ride_length`` and ``day_of_week``.

    Order (both specifications): rename -> missing -> parse -> trim ->
    (title case / text fixes) -> minutes -> minimum duration. ``audit`` is filled
    with the counts of ``value_audit`` when the trips are written."""
    p = profile
    df = (_left_by_key if p.mode == "key" else _left_by_row)(raw, p)
    if audit is not None:
        df = observed(df, text_metrics(df, p), audit)
    df = add_duration(polish_text(trim_text(df, p.trim), p), p.fractional)
    return df if p.mode == "key" else df.filter(F.col("ride_length") >= F.lit(p.min_minutes))


def clean_trips_stepwise(raw: DataFrame, profile: Profile = SQL) -> DataFrame:
    """Literal step-by-step form of the key-mode pipeline (two anti joins);
    kept as the reference definition the folded plan is tested against."""
    p = profile
    df = rename_raw(raw)
    if p.clip:
        df = clip_coordinates(df)
    df = drop_missing(df, "key", marks=p.marks)
    df = trim_text(parse_times(df, parse=parser(p)), p.trim)
    df = polish_text(df, p)
    df = min_duration(df, "key", p.min_minutes, KEY, p.fractional)
    return add_duration(df, p.fractional)


def explore_view(trips: DataFrame) -> DataFrame:
    """The stakeholder view: every cleaned column except ``ride_id``."""
    return trips.drop(KEY)
