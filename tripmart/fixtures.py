"""Test input: raw trips derived from the driver's ``events`` table.

The rows are integer arithmetic on ``event_id`` / ``user_id`` so Spark and
DuckDB produce identical text. Defects (blank and NULL fields, negative and
huge durations, colliding ids, exact copies, padded and misspelt station
names) are injected so every cleaning rule has something to act on. The
work grows with ``events``: one output row per event (plus copies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ADAPTER = """
with base as (
  select *, {shift_day} as st, (event_id * event_id) % 12 as si,
    case when event_id % 8 < 5 then 1 when event_id % 8 < 7 then 4 else 2 end as ei,
    case when event_id % 101 = 0 then -5 when event_id % 997 = 0 then 100500 else floor(value) end as dur
  from {events}),
copies as (select * from base union all select * from base where event_id % 499 = 0)
select lpad(cast(case when event_id % 503 = 1 then event_id - 1 else event_id end as {str}), 16, '0') as ride_id,
  case when event_id % 37 = 0 then '' else case event_id % 3 when 0 then 'classic_bike' when 1 then 'electric_bike' else 'docked_bike' end end as rideable_type,
  {fmt_start} as started_at, {fmt_end} as ended_at,
  case when event_id % 41 = 0 then null else case si when 0 then 'Clybourne Ave & Division St' when 1 then 'Clark St & Elm St' when 4 then 'Wells St & Concord Ln' when 9 then '  Streeter Dr & Grand Ave ' else 'Kingsbury St  & Kinzie St' end end as start_station_name,
  concat('S', cast(si as {str})) as start_station_id,
  case ei when 0 then 'Clybourne Ave & Division St' when 1 then 'Clark St & Elm St' when 4 then 'Wells St & Concord Ln' when 9 then '  Streeter Dr & Grand Ave ' else 'Kingsbury St  & Kinzie St' end as end_station_name,
  concat('S', cast(ei as {str})) as end_station_id,
  cast(41.8 + si * 0.01 as decimal(12,10)) as start_lat, cast(-87.6 - si * 0.01 as decimal(12,10)) as start_lng,
  case when event_id % 43 = 0 then null else cast(41.8 + ei * 0.01 as decimal(12,10)) end as end_lat,
  cast(-87.6 - ei * 0.01 as decimal(12,10)) as end_lng,
  case when user_id % 3 = 0 then 'casual' else 'member' end as member_casual
from copies
"""

SPARK_ADAPTER = _ADAPTER.format(
    shift_day="timestampadd(DAY, cast((event_id % 12) * 30 as int), ts)",
    events="{events}",
    str="string",
    fmt_start="date_format(st, 'M/d/yyyy H:mm')",
    fmt_end="date_format(timestampadd(MINUTE, cast(dur as int), st), 'M/d/yyyy H:mm')",
)

DUCKDB_ADAPTER = _ADAPTER.format(
    shift_day="ts + to_days(cast((event_id % 12) * 30 as int))",
    events="events",
    str="varchar",
    fmt_start="strftime(st, '%-m/%-d/%Y %-H:%M')",
    fmt_end="strftime(st + to_minutes(cast(dur as int)), '%-m/%-d/%Y %-H:%M')",
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips (the 13 columns of ``RAW_SCHEMA``) derived from ``events``."""
    return spark.sql(SPARK_ADAPTER, events=events(spark, sf_dir))
