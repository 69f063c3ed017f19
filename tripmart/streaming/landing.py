"""Incremental landing of monthly trip files with Structured Streaming.

The reference appends one monthly CSV file after another into one table and
cleans it. Row-mode cleaning is stateless (project + filter), so the same
``clean_trips`` plan runs unchanged on a ``readStream`` source: each new
file is parsed, cleaned and appended to a month-partitioned Parquet table,
exactly once (file source + checkpointed sink). Key-mode cleaning needs
every row that shares a ``ride_id`` - a whole-table property - so it stays
a batch step over the landed table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tripmart.functions.time import period
from tripmart.operators.clean import R, Profile, clean_trips
from tripmart.schema import RAW_DOUBLES, RAW_SCHEMA
from tripmart.sources.csv import CSV_OPTIONS, clipped, lossless


def read_trip_stream(
    spark: SparkSession,
    raw_dir: str,
    schema: T.StructType = RAW_SCHEMA,
    glob: str = "*.csv",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """New CSV files under ``raw_dir`` as a stream (explicit schema, header
    skipped, one file = one month)."""
    r = (
        spark.readStream.schema(lossless(schema))
        .option("header", True)
        .option("enforceSchema", True)
        .option("pathGlobFilter", glob)
        .options(**CSV_OPTIONS)
    )
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return clipped(r.csv(raw_dir), schema)


def clean_stream(raw: DataFrame, profile: Profile = R) -> DataFrame:
    """Row-mode cleaning of a streaming (or batch) frame, plus ``period``."""
    if profile.mode != "row":
        raise ValueError("key-mode deletes look at every row of a key; run them in batch on the landed table")
    return clean_trips(raw, profile).withColumn("period", period("started_at"))


def land_trips(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    checkpoint_dir: str,
    profile: Profile = R,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the landing query: files in ``raw_dir`` -> cleaned Parquet in
    ``out_dir`` partitioned by month; progress in ``checkpoint_dir`` (a
    shared folder, so a restarted driver resumes where it stopped)."""
    cleaned = clean_stream(read_trip_stream(spark, raw_dir, RAW_DOUBLES), profile)
    w = (
        cleaned.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint_dir)
        .partitionBy("period")
        .outputMode("append")
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out_dir)
