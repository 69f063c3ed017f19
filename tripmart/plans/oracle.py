"""Independent DuckDB definitions of the cleaned tables, used as the value
oracle for every registered query. Written straight from the two
specifications (step by step, with ``NOT EXISTS`` for the key deletes),
not from the Spark plans."""

from __future__ import annotations

from tripmart.fixtures import DUCKDB_ADAPTER

TEXT = ["ride_id", "bike_type", "started_at", "ended_at", "start_sta_name", "start_sta_id", "end_sta_name", "end_sta_id", "user_type"]
COORDS = ["start_lat", "start_lng", "end_lat", "end_lng"]
TRIM7 = ["ride_id", "bike_type", "start_sta_name", "start_sta_id", "end_sta_name", "end_sta_id", "user_type"]
TITLE4 = ["bike_type", "start_sta_name", "end_sta_name", "user_type"]
RAW_TEXT = ["ride_id", "rideable_type", "started_at", "ended_at", "start_station_name", "start_station_id", "end_station_name", "end_station_id", "member_casual"]
RAW_ALL = RAW_TEXT[:8] + COORDS + ["member_casual"]

TS_FMT = "'%m/%d/%Y %H:%M'"
WS = r"[\t\n\x0B\f\r\x85\p{Z}]"


def miss(prefix: str = "") -> str:
    p = prefix
    parts = [f"{p}{c} IS NULL OR {p}{c} = ''" for c in TEXT if c != "user_type"]
    parts += [f"{p}{c} IS NULL" for c in COORDS]
    parts.append(f"{p}user_type IS NULL OR {p}user_type = ''")
    return "(" + " OR ".join(parts) + ")"


def parse(c: str) -> str:
    return f"try_strptime({c}, {TS_FMT})"


def strip_ws(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def initcap(c: str) -> str:
    """Letter by letter: upper case unless the one before is part of the same word, or
    is an apostrophe or dot that itself follows a letter."""
    low = f"lower({c})"
    inside = f"regexp_matches({low}[i - 1], '[\\p{{L}}\\p{{M}}\\p{{N}}_]')"
    joined = f"(contains(chr(39) || '’.', {low}[i - 1]) AND {low}[i - 1] <> '' AND regexp_matches({low}[i - 2], '[\\p{{L}}\\p{{M}}]'))"
    letter = f"CASE WHEN i > 1 AND ({inside} OR (i > 2 AND {joined})) THEN {low}[i] ELSE upper({low}[i]) END"
    return f"CASE WHEN {c} IS NOT NULL THEN array_to_string(list_transform(range(1, length({c}) + 1), lambda i: {letter}), '') END"


def minutes(a: str = "started_at", b: str = "ended_at") -> str:
    return f"date_sub('minute', {a}, {b})"


def minutes_frac(a: str = "started_at", b: str = "ended_at") -> str:
    return f"(date_sub('microsecond', {a}, {b}) / 60000000.0::DOUBLE)"


def replace_cols(cols, fn) -> str:
    return ", ".join(f"{fn(c)} AS {c}" for c in cols)


def blank_null_raw() -> str:
    """Raw columns with blank text as NULL (what a CSV round trip returns)."""
    return ", ".join(f"nullif({c}, '') AS {c}" if c in RAW_TEXT else c for c in RAW_ALL)


CTES = f"""
raw AS ({DUCKDB_ADAPTER}),
renamed AS (
  SELECT ride_id, rideable_type AS bike_type, started_at, ended_at, start_station_name AS start_sta_name,
         start_station_id AS start_sta_id, end_station_name AS end_sta_name, end_station_id AS end_sta_id,
         start_lat, start_lng, end_lat, end_lng, member_casual AS user_type
  FROM raw),
parsed_all AS (SELECT * REPLACE ({parse('started_at')} AS started_at, {parse('ended_at')} AS ended_at) FROM renamed),
s_flag AS (SELECT *, {miss()} AS miss FROM renamed),
s_step1 AS (SELECT * EXCLUDE (miss) FROM s_flag f
            WHERE NOT EXISTS (SELECT 1 FROM s_flag b WHERE b.miss AND b.ride_id = f.ride_id)),
s_parsed AS (SELECT * REPLACE ({parse('started_at')} AS started_at, {parse('ended_at')} AS ended_at) FROM s_step1),
s_trimmed AS (SELECT * REPLACE ({replace_cols(TRIM7, lambda c: f'trim({c})')}) FROM s_parsed),
s_step2 AS (SELECT * FROM s_trimmed t
            WHERE NOT EXISTS (SELECT 1 FROM s_trimmed b WHERE {minutes('b.started_at', 'b.ended_at')} < 1 AND b.ride_id = t.ride_id)),
sql_trips AS (SELECT *, {minutes()} AS ride_length, dayname(started_at) AS day_of_week FROM s_step2),
r_step1 AS (SELECT * FROM renamed WHERE NOT {miss()}),
r_parsed AS (SELECT * REPLACE ({parse('started_at')} AS started_at, {parse('ended_at')} AS ended_at) FROM r_step1),
r_trimmed AS (SELECT * REPLACE ({replace_cols(TRIM7, strip_ws)}) FROM r_parsed),
r_titled AS (SELECT * REPLACE ({replace_cols(TITLE4, initcap)}) FROM r_trimmed),
r_trips AS (SELECT *, {minutes_frac()} AS ride_length, dayname(started_at) AS day_of_week
            FROM r_titled WHERE {minutes_frac()} >= 1)
"""


def q(select: str, extra: str = "") -> str:
    """Full oracle text: the shared CTEs, optional extra CTEs, the select."""
    more = f",\n{extra}" if extra else ""
    return f"WITH {CTES}{more}\n{select}"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
