"""Views for users who write their own SQL: ``register_views`` cleans the raw
trips with the SQL profile and registers them as ``trips`` (the cleaned table,
with ``ride_length`` and ``day_of_week``) and ``explore_vw`` (the same without
``ride_id``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripmart.operators.clean import SQL, clean_trips
from tripmart.sources.tables import register_explore_view


def register_views(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Clean ``raw`` (SQL profile) and register ``trips`` and ``explore_vw``."""
    trips = clean_trips(raw, SQL)
    trips.createOrReplaceTempView("trips")
    register_explore_view(trips)
    return trips
