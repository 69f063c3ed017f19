"""Typed tables, zones and the stakeholder view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.functions.text import bounded_text
from tripmart.functions.time import parse_timestamp, period
from tripmart.operators.clean import explore_view
from tripmart.sources.csv import clip_decimal
from tripmart.schema import RAW_SCHEMA, TEXT_BOUNDS

ZONES = ("raw", "interim", "marts")


def zone_path(root: str, zone: str, name: str) -> str:
    """``<root>/<zone>/<name>``: raw -> interim -> marts."""
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone!r}")
    return f"{root.rstrip('/')}/{zone}/{name}"


def bounded(df: DataFrame, bounds=TEXT_BOUNDS) -> DataFrame:
    """Apply the declared text widths (truncate) and decimal type (out of
    range -> nearest bound) of the typed table. ``audit.load_metrics`` counts both."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in bounds:
            c = bounded_text(c, bounds[f.name])
        target = next((g.dataType for g in RAW_SCHEMA.fields if g.name == f.name), None)
        if isinstance(target, T.DecimalType):
            c = clip_decimal(c, target)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def period_of_start(c: str = "started_at"):
    """``YYYYMM`` of the trip start (text)."""
    return period(parse_timestamp(c))


def write_typed(df: DataFrame, path: str, partition_by: Sequence[str] = ("period",)) -> None:
    """Land a typed table as Parquet partitioned by month (partition pruning
    for month filters; columnar pruning for every mart)."""
    if partition_by:  # few files per month whatever the input's order
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a landed table with its schema (partition columns included, so
    ``period`` stays text instead of being inferred as a number)."""
    return spark.read.schema(schema).parquet(path)


def register_explore_view(trips: DataFrame, name: str = "explore_vw") -> DataFrame:
    """The stakeholder view (no ``ride_id``) as a session temp view."""
    explore_view(trips).createOrReplaceTempView(name)
    return trips.sparkSession.table(name)
