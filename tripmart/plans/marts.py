"""The result tables (marts). Each takes a cleaned trip frame (``clean_trips``)
and returns a small DataFrame; each is one job whose only shuffle carries
partial aggregates.

SQL-script marts expect the ``SQL`` profile (key mode, whole minutes,
lower-case labels); R-script marts expect the ``R`` profile (row mode,
title case, fractional minutes).

Count and mean marts also accept a trip *summary* (``plans.summary``) with
``w=Weights()``: counts become sums of the row weight and means become
sum / count of ride length, so one scan of the cleaned table serves them all.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripmart.functions.columns import relabel
from tripmart.functions.time import hour_label, month_name, month_number
from tripmart.operators.aggregate import (
    Weights,
    cube_labeled,
    histogram,
    len_count_measure,
    len_mean_measure,
    pivot_wide,
    rollup_labeled,
    rows_measure,
    running_sum,
    share_of_group,
    thousands_label,
)
from tripmart.operators.join import band_case, band_join, route_within_bbox
from tripmart.operators.order import level_rank, order_by_field, order_by_levels, top_k
from tripmart.schema import (
    BANDS,
    BIKE_LABELS,
    DAY_TYPE_WEEKEND,
    DAY_TYPE_WORK,
    FREQUENT_MAX_LOW,
    FREQUENT_MIN_HIGH,
    HOURS_PADDED,
    HOURS_UNPADDED,
    MAP_WINDOW,
    MONTHS,
    POPULAR_MIN_RIDES,
    R_TOTALS,
    ROUTE_HIGH,
    ROUTE_LOW,
    SQL_TOTALS,
    USER_TYPES_SQL,
    VAR_LABELS,
    WEEKDAYS,
    WEEKEND,
    WORKDAYS,
)

L = "ride_length"


# --- SQL-script marts (key-mode trips) --------------------------------------------


def avg_by_user(trips: DataFrame, total: str = SQL_TOTALS["user"], digits: int | None = 2, w: Weights | None = None) -> DataFrame:
    """M1: mean ride length per user type plus the combined mean."""
    return rollup_labeled(trips, ["user_type"], [len_mean_measure("avg_ride_length_min", L, w, digits=digits)], {"user_type": total})


def min_length(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """M2."""
    return trips.agg(F.min(L if w is None else w.min_len).alias("min_ride_length_min"))


def max_length(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """M3."""
    return trips.agg(F.max(L if w is None else w.max_len).alias("max_ride_length_min"))


def avg_by_weekday(trips: DataFrame, total: str = SQL_TOTALS["user"], w: Weights | None = None) -> DataFrame:
    """M4: mean ride length, user type x weekday, wide, with total row and
    column - one conditional mean per weekday inside the same aggregate."""
    day = F.col("day_of_week")
    ms = [len_mean_measure(f"avg_ride_length_{d.lower()}", L, w, when=day == F.lit(d)) for d in WEEKDAYS]
    ms.append(len_mean_measure("avg_ride_length_total", L, w))
    return rollup_labeled(trips, ["user_type"], ms, {"user_type": total})


def count_by_weekday(trips: DataFrame, total: str = SQL_TOTALS["user"], w: Weights | None = None) -> DataFrame:
    """M5: ride count, user type x weekday, wide, with totals."""
    day = F.col("day_of_week")
    ms = [rows_measure(f"num_rides_{d.lower()}", w, when=day == F.lit(d)) for d in WEEKDAYS]
    ms.append(rows_measure("grand_total", w))
    return rollup_labeled(trips, ["user_type"], ms, {"user_type": total})


def band_rollup(spark: SparkSession, trips: DataFrame, bands=BANDS, w: Weights | None = None) -> DataFrame:
    """Rides per duration band (range join) x user type, ROLLUP."""
    keep = [] if w is None else [w.n_len]
    users = trips.select("user_type", F.col(L).alias("total_minutes"), *keep)
    joined = band_join(users, "total_minutes", bands)
    out = rollup_labeled(
        joined,
        ["name", "user_type"],
        [len_count_measure("number_of_users", "total_minutes", w)],
        {"name": SQL_TOTALS["band"], "user_type": SQL_TOTALS["user"]},
        {"name": "category_name", "user_type": "user_types"},
    )
    return out.orderBy(F.desc("category_name"))


def _weights(w: Weights | None) -> list[str]:
    return [] if w is None else [w.rows]


def month_rollup(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """Rides per month x user type, ROLLUP, calendar order."""
    months = trips.select("user_type", month_name("started_at").alias("month_name"), *_weights(w))
    out = rollup_labeled(
        months,
        ["month_name", "user_type"],
        [rows_measure("number_of_users", w)],
        {"month_name": SQL_TOTALS["month"], "user_type": SQL_TOTALS["user"]},
        {"month_name": "month", "user_type": "user_types"},
    )
    return order_by_field(out, ("month", MONTHS + [SQL_TOTALS["month"]]), ("user_types", USER_TYPES_SQL + [SQL_TOTALS["user"]]))


def top_routes(trips: DataFrame, k: int = 10) -> DataFrame:
    """M8: the ``k`` most frequent (start, end) station pairs."""
    routes = trips.groupBy("start_sta_name", "end_sta_name").agg(
        F.count("start_sta_name").alias("total_rides_occurred")
    )
    return top_k(routes, k, [F.desc("total_rides_occurred")], ["start_sta_name", "end_sta_name"])


def hour_rollup(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """Rides per hour of day (``1 AM``) plus the total, clock order."""
    hours = trips.select(hour_label("started_at", padded=False).alias("hour"), *_weights(w))
    out = rollup_labeled(
        hours, ["hour"], [rows_measure("total_rides", w)], {"hour": SQL_TOTALS["hour"]}, {"hour": "hour_of_the_day"}
    )
    return order_by_field(out, ("hour_of_the_day", HOURS_UNPADDED + [SQL_TOTALS["hour"]]))


# --- R-script marts (row-mode trips) ----------------------------------------------


def avg_by_user_r(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """M1 as in R: unrounded means plus a ``Combined`` row."""
    return avg_by_user(trips, R_TOTALS["user"], None, w)


def weekday_pivot_r(trips: DataFrame, measure: str = "avg", w: Weights | None = None) -> DataFrame:
    """M4 / M5 as in R: user type x weekday with totals for both keys
    (a cube, the ``United`` row and the ``gt`` column), pivoted wide with
    a name prefix and a fixed column order."""
    if measure == "avg":
        m, prefix = len_mean_measure("v", L, w), "avg_ride_length_"
    else:
        m, prefix = rows_measure("v", w), "num_rides_"
    long = cube_labeled(
        trips, ["user_type", "day_of_week"], [m], {"user_type": R_TOTALS["user_cube"], "day_of_week": R_TOTALS["weekday"]}
    )
    return pivot_wide(long, ["user_type"], "day_of_week", WEEKDAYS + [R_TOTALS["weekday"]], "v", prefix)


OPEN_BANDS = [(n, lo, None if i == len(BANDS) - 1 else hi) for i, (n, lo, hi) in enumerate(BANDS)]


def band_cube(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """Rides per duration band (CASE, with ``Other``) x user type, CUBE."""
    levels = trips.select("user_type", band_case(L, OPEN_BANDS).alias("ride_levels"), *_weights(w))
    out = cube_labeled(
        levels,
        ["ride_levels", "user_type"],
        [rows_measure("number_of_users", w)],
        {"ride_levels": R_TOTALS["band"], "user_type": R_TOTALS["user_cube"]},
    )
    return out.orderBy(F.desc("ride_levels"))


def month_cube(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """Rides per month x user type, CUBE, factor order (39 rows for a year)."""
    months = trips.select("user_type", month_name("started_at").alias("month_names"), *_weights(w))
    out = cube_labeled(
        months,
        ["month_names", "user_type"],
        [rows_measure("number_of_users", w)],
        {"month_names": R_TOTALS["month"], "user_type": R_TOTALS["user_cube"]},
    )
    return order_by_levels(out, ("month_names", MONTHS + [R_TOTALS["month"]]))


def hour_rollup_padded(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """Rides per hour of day (``01 AM``) plus ``Total``, factor order."""
    hours = trips.select(hour_label("started_at", padded=True).alias("hour_of_the_day"), *_weights(w))
    out = rollup_labeled(
        hours, ["hour_of_the_day"], [rows_measure("total_rides", w)], {"hour_of_the_day": R_TOTALS["hour"]}
    )
    return order_by_levels(out, ("hour_of_the_day", HOURS_PADDED + [R_TOTALS["hour"]]))


def user_bike_tree(
    trips: DataFrame,
    node_labels: Mapping[str, str] = BIKE_LABELS,
    var_labels: Mapping[str, str] = VAR_LABELS,
    w: Weights | None = None,
) -> DataFrame:
    """The all -> user type -> bike type tree: count and percent of the
    parent node per node. One rollup; the parent counts come from two
    windows over the (few) rollup rows."""
    detail = trips.groupBy("user_type", "bike_type").agg(_count(w).alias("_n"))
    t = detail.rollup("user_type", "bike_type").agg(
        F.sum("_n").alias("n"), F.grouping("user_type").alias("_gu"), F.grouping("bike_type").alias("_gb")
    )
    depth = F.lit(2) - F.col("_gu") - F.col("_gb")
    t = t.withColumn("level", depth.cast("int"))
    by_user = Window.partitionBy("_gu", "user_type")
    by_level = Window.partitionBy("_gb")
    parent = (
        F.when(F.col("level") == 2, F.max(F.when(F.col("level") == 1, F.col("n"))).over(by_user))
        .when(F.col("level") == 1, F.max(F.when(F.col("level") == 0, F.col("n"))).over(by_level))
        .otherwise(F.col("n"))
    )
    variable = (
        F.when(F.col("level") == 1, F.lit(var_labels["user_type"]))
        .when(F.col("level") == 2, F.lit(var_labels["bike_type"]))
    )
    return t.select(
        "level",
        variable.alias("variable"),
        F.when(F.col("_gu") == 0, F.col("user_type")).alias("user_type"),
        F.when(F.col("_gb") == 0, relabel("bike_type", node_labels)).alias("bike_type"),
        "n",
        (F.col("n").cast("double") * F.lit(100.0) / parent).alias("pct_of_parent"),
    )


def length_histogram(trips: DataFrame, width: float = 1.0, show_from: float | None = 0, show_to: float | None = 50) -> DataFrame:
    """Histogram of ride length, width 1, shown 0-50, with empty bins; the
    count also as the axis shows it."""
    out = histogram(trips, L, width, show_from, show_to, "ride_length_bin", "total_rides")
    return out.withColumn("total_rides_k", thousands_label("total_rides"))


def _count(w: Weights | None):
    """COUNT(*) on trips, the sum of the row weight on a summary."""
    return F.count(F.lit(1)) if w is None else F.sum(w.rows)


def monthly_trend(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """Rides per user type and month (abbreviated month, month number,
    and the count in thousands as the chart axis shows it)."""
    m = trips.select(
        "user_type", month_name("started_at", abbr=True).alias("month_name"), month_number("started_at").alias("month_no"), *_weights(w)
    )
    out = m.groupBy("user_type", "month_name", "month_no").agg(_count(w).alias("total_rides"))
    return out.withColumn("total_rides_k", thousands_label("total_rides"))


def weekday_bars(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """Rides per weekday x user type, Monday-first rank; the count also as
    the axis shows it."""
    out = trips.groupBy("day_of_week", "user_type").agg(_count(w).alias("total_rides"))
    out = out.withColumn("total_rides_k", thousands_label("total_rides"))
    return out.withColumn("day_rank", level_rank("day_of_week", WEEKDAYS)).orderBy(
        F.col("day_rank").asc_nulls_last(), "user_type"
    )


def hour_heatmap(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """Rides per weekday x hour of day, with Monday-first day rank and
    clock-order hour rank."""
    h = trips.select("day_of_week", hour_label("started_at", padded=True).alias("hour_of_the_day"), *_weights(w))
    out = h.groupBy("day_of_week", "hour_of_the_day").agg(_count(w).alias("total_rides"))
    return out.withColumns(
        {"day_rank": level_rank("day_of_week", WEEKDAYS), "hour_rank": level_rank("hour_of_the_day", HOURS_PADDED)}
    )


def day_type(c: str = "day_of_week"):
    return F.when(F.col(c).isin(*WORKDAYS), F.lit(DAY_TYPE_WORK)).when(F.col(c).isin(*WEEKEND), F.lit(DAY_TYPE_WEEKEND))


def daytype_share(trips: DataFrame, w: Weights | None = None) -> DataFrame:
    """Weekday vs weekend rides per user type, share of the user type
    (percent) and the running label position ``cumsum(prop - 0.5 * prop)``
    in descending day-type order."""
    out = trips.groupBy("user_type", day_type().alias("day_type")).agg(_count(w).alias("total"))
    out = out.withColumn("prop", share_of_group("total", ["user_type"]))
    half = F.col("prop") - F.lit(0.5) * F.col("prop")
    return out.withColumn("ypos", running_sum(half, ["user_type"], [F.desc_nulls_last("day_type")]))


def popular_routes(
    trips: DataFrame,
    min_rides: int = POPULAR_MIN_RIDES,
    low_max: int = FREQUENT_MAX_LOW,
    high_min: int = FREQUENT_MIN_HIGH,
) -> DataFrame:
    """Routes by coordinates and user type with at least ``min_rides``
    rides, round trips excluded, with a frequency class."""
    routes = trips.filter(F.col("start_sta_name") != F.col("end_sta_name"))
    out = routes.groupBy("start_lat", "start_lng", "end_lat", "end_lng", "user_type").agg(
        F.count(F.lit(1)).alias("total_rides")
    )
    out = out.filter(F.col("total_rides") >= F.lit(min_rides))
    category = F.when(F.col("total_rides") <= F.lit(low_max), F.lit(ROUTE_LOW)).when(
        F.col("total_rides") >= F.lit(high_min), F.lit(ROUTE_HIGH)
    )
    return out.withColumn("category", category)


def segment(routes: DataFrame, user_type: str) -> DataFrame:
    """One rider segment of a route set (``filter(user_type == ...)``)."""
    return routes.filter(F.col("user_type") == F.lit(user_type))


def map_routes(trips: DataFrame, box: Mapping[str, float] = MAP_WINDOW, min_rides: int = POPULAR_MIN_RIDES) -> DataFrame:
    """The member and casual popular-route sets that fall inside the
    map window (both endpoints)."""
    return map_routes_of(popular_routes(trips, min_rides), box)


def map_routes_of(routes: DataFrame, box: Mapping[str, float] = MAP_WINDOW) -> DataFrame:
    """M17 from an M16 result (no second pass over the trips)."""
    return routes.filter(route_within_bbox(box) & F.col("user_type").isin("Member", "Casual"))

