"""Timestamp parsing, durations and calendar labels (built-ins only).

Timestamps are ``TIMESTAMP_NTZ`` (wall-clock, no zone). Durations are NTZ
differences and labels come from NTZ field extraction - never a cast to
the zoned type - so results do not depend on the session time zone (a
time in a DST gap keeps its value, label and duration).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripmart.functions.columns import as_col
from tripmart.schema import MONTHS, WEEKDAYS_SUNDAY_FIRST


# How the two specifications read "month/day/year hour:minute" text. The text is put
# behind an ``x``, so a match is what no longer starts with one.
_NO = r"[^\p{L}\p{N}]"
TS_PREFIX = r"(?s)^x\s*(\d{1,2})\s*/\s*(\d{1,2})\s*/\s*(\d{3,4}|\d{1,2})\s*(\d{1,2})\s*:\s*(\d{1,2}).*$"
TS_WHOLE = rf"(?s)^x{_NO}*(\d{{1,2}}){_NO}+(\d{{1,2}}){_NO}+(\d{{4}}|\d{{2}}){_NO}+(\d{{1,2}}){_NO}+(\d{{1,2}}){_NO}*$"


def _parsed(c, pattern: str, last_2000: int) -> Column:
    """One regular expression and one cast; what does not match is NULL. Years of two
    digits up to ``last_2000`` are of this century."""
    iso = F.regexp_replace(F.concat(F.lit("x"), as_col(c)), pattern, "$3-$1-$2 $4:$5")
    tens, ones = divmod(last_2000, 10)
    early = rf"^([0-{tens - 1}]\d|{tens}[0-{ones}])-"
    iso = F.regexp_replace(F.regexp_replace(iso, early, "20$1-"), r"^(\d\d)-", "19$1-")
    return iso.try_cast("timestamp_ntz")


def parse_timestamp(c) -> Column:
    """Text to ``TIMESTAMP_NTZ`` as the SQL script's format reads it: blanks may stand
    before every part, one or two digits per part, whatever follows the minute is ignored,
    two-digit years to 69 are 20xx. Anything else is NULL; a wall-clock time inside
    a DST gap is kept as written."""
    return _parsed(c, TS_PREFIX, 69)


def parse_mdy_hm(c) -> Column:
    """Text to ``TIMESTAMP_NTZ`` as the R script reads it: any separators that are neither
    letters nor digits, nothing else after the minute, two-digit years to 68 are
    20xx. Anything else is NULL."""
    return _parsed(c, TS_WHOLE, 68)


def _elapsed(start, end) -> Column:
    """``end - start`` as a day-time interval. Subtracting two NTZ values
    involves no time zone, and each operand is referenced once (the
    operands are often parse expressions that Catalyst inlines)."""
    return as_col(end) - as_col(start)


def minutes_between(start, end) -> Column:
    """Whole minutes from ``start`` to ``end``, truncated toward zero (BIGINT)."""
    return _elapsed(start, end).cast("interval minute").cast("bigint")


def elapsed_micros(start, end) -> Column:
    """Exact microseconds from ``start`` to ``end`` (BIGINT)."""
    secs = _elapsed(start, end).cast("interval second").cast("decimal(20,6)")
    return (secs * F.lit(1_000_000)).cast("bigint")


def minutes_fractional(start, end) -> Column:
    """Exact minutes from ``start`` to ``end`` as DOUBLE."""
    return elapsed_micros(start, end) / F.lit(60_000_000.0)


def _pick(names, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index)


def day_name(ts) -> Column:
    """Full English weekday name (``Monday``)."""
    return _pick(WEEKDAYS_SUNDAY_FIRST, F.dayofweek(as_col(ts)))


def day_rank_sunday_first(ts) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(as_col(ts))


def day_rank_monday_first(ts) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(as_col(ts)) + F.lit(1)


def weekday_number(ts) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(as_col(ts))


def month_name(ts, abbr: bool = False) -> Column:
    """Full (``January``) or abbreviated (``Jan``) English month name."""
    full = _pick(MONTHS, F.month(as_col(ts)))
    return F.substring(full, 1, 3) if abbr else full


def month_number(ts) -> Column:
    return F.month(as_col(ts))


def period(ts) -> Column:
    """``YYYYMM`` of the wall-clock value."""
    c = as_col(ts)
    return F.format_string("%04d%02d", F.year(c), F.month(c))


def hour_label(ts, padded: bool = False) -> Column:
    """12-hour clock label: ``1 AM`` (unpadded) or ``01 AM`` (padded)."""
    h = F.hour(as_col(ts))
    h12 = ((h + F.lit(11)) % F.lit(12) + F.lit(1)).cast("string")
    if padded:
        h12 = F.lpad(h12, 2, "0")
    return F.concat(h12, F.when(h < F.lit(12), F.lit(" AM")).otherwise(F.lit(" PM")))


def hour_rank(ts) -> Column:
    """0 .. 23, the clock order of the hour labels (12 AM first)."""
    return F.hour(as_col(ts))
