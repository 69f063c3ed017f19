"""One scan of a cleaned trip table -> a small weighted summary that serves
every count / mean mart.

The summary groups trips by the low-cardinality attributes the marts group
on - user type, bike type, month, weekday, hour and both duration bands -
and carries the row count plus count / sum / min / max of ride length.
Its size is bounded by the attribute domains (2 x 3 x 12 x 7 x 24 x a few
bands per profile), not by the number of trips. Every mart label is a
function of the group keys, so each row also keeps a representative
``started_at`` / ``ride_length`` / ``day_of_week`` from which the marts
derive their labels exactly as they do on trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.operators.aggregate import Weights
from tripmart.operators.join import band_case
from tripmart.plans.marts import OPEN_BANDS
from tripmart.schema import BANDS

W = Weights()
L = "ride_length"


def trip_summary(trips: DataFrame, w: Weights = W) -> DataFrame:
    """Pre-aggregate cleaned trips (one partial hash aggregate; a hot
    attribute combination is combined map-side)."""
    ts = F.col("started_at")
    keys = [
        F.col("user_type"),
        F.col("bike_type"),
        F.month(ts).alias("_month"),
        F.dayofweek(ts).alias("_dow"),
        F.hour(ts).alias("_hour"),
        band_case(L, BANDS, other=None).alias("_band_join"),
        band_case(L, OPEN_BANDS).alias("_band_case"),
    ]
    return trips.groupBy(*keys).agg(
        F.min("started_at").alias("started_at"),
        F.min("day_of_week").alias("day_of_week"),
        F.min(L).alias(L),
        F.count(F.lit(1)).alias(w.rows),
        F.count(L).alias(w.n_len),
        F.sum(L).alias(w.sum_len),
        F.min(L).alias(w.min_len),
        F.max(L).alias(w.max_len),
    )
