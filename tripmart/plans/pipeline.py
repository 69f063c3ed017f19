"""The production job: raw monthly files -> cleaned tables -> marts.

``run_pipeline`` lands each cleaning profile once as Parquet partitioned by
month (interim zone), summarises it in one scan, then computes every mart
(marts zone). Cleaning - parsing, trimming and the key-mode anti join - is
paid once per load instead of once per mart, and the cleaned table is read
once for all count / mean marts (through the summary) plus once per
trip-level mart (top routes, histogram, popular routes), each reading only
the columns it needs. Writing the cleaned tables
also cuts the lineage: a lost executor during the marts re-reads files
instead of recomputing the cleaning.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tripmart.operators.clean import R, SQL, Profile, clean_trips
from tripmart.functions.time import period
from tripmart.operators.aggregate import Weights
from tripmart.plans import marts as M
from tripmart.plans.summary import W, trip_summary
from tripmart.session import publish, remove, run_scratch
from tripmart.sources.tables import period_of_start, write_typed, zone_path

Mart = Callable[[SparkSession, DataFrame, Weights | None], DataFrame]

# Marts of the SQL script run on key-mode trips, marts of the R script on
# row-mode trips (see the module docstring of ``marts``). ``SUMMARY`` marts
# read the weighted trip summary; the others need trip-level columns
# (station names, exact ride length, coordinates) and read the trips.
SQL_MARTS: dict[str, Mart] = {
    "avg_by_user": lambda s, t, w: M.avg_by_user(t, w=w),
    "min_length": lambda s, t, w: M.min_length(t, w=w),
    "max_length": lambda s, t, w: M.max_length(t, w=w),
    "avg_by_weekday": lambda s, t, w: M.avg_by_weekday(t, w=w),
    "count_by_weekday": lambda s, t, w: M.count_by_weekday(t, w=w),
    "band_rollup": lambda s, t, w: M.band_rollup(s, t, w=w),
    "month_rollup": lambda s, t, w: M.month_rollup(t, w=w),
    "hour_rollup": lambda s, t, w: M.hour_rollup(t, w=w),
    "top_routes": lambda s, t, w: M.top_routes(t),
}
R_MARTS: dict[str, Mart] = {
    "avg_by_user_r": lambda s, t, w: M.avg_by_user_r(t, w=w),
    "avg_by_weekday_r": lambda s, t, w: M.weekday_pivot_r(t, "avg", w=w),
    "count_by_weekday_r": lambda s, t, w: M.weekday_pivot_r(t, "count", w=w),
    "band_cube": lambda s, t, w: M.band_cube(t, w=w),
    "month_cube": lambda s, t, w: M.month_cube(t, w=w),
    "hour_rollup_padded": lambda s, t, w: M.hour_rollup_padded(t, w=w),
    "user_bike_tree": lambda s, t, w: M.user_bike_tree(t, w=w),
    "monthly_trend": lambda s, t, w: M.monthly_trend(t, w=w),
    "weekday_bars": lambda s, t, w: M.weekday_bars(t, w=w),
    "hour_heatmap": lambda s, t, w: M.hour_heatmap(t, w=w),
    "daytype_share": lambda s, t, w: M.daytype_share(t, w=w),
    "length_histogram": lambda s, t, w: M.length_histogram(t),
    "popular_routes": lambda s, t, w: M.popular_routes(t),
}
TRIP_LEVEL = {"top_routes", "length_histogram", "popular_routes"}
# Marts computed from another mart's written output: name -> (source, fn).
DERIVED: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "map_routes": ("popular_routes", M.map_routes_of),
}


def land_clean(raw: DataFrame, path: str, profile: Profile) -> DataFrame:
    """Clean ``raw`` with ``profile`` and land it as Parquet partitioned by
    the month of the trip start; returns the landed table.

    The cleaned rows keep the month clustering of the landed raw files, so
    each task writes about one month; the few rows that key mode decided by a
    join are tasks of their own."""
    trips = clean_trips(raw, profile).withColumn("period", period("started_at"))
    trips.write.mode("overwrite").partitionBy("period").parquet(path)
    return raw.sparkSession.read.parquet(path)


def run_pipeline(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    sql_marts: Mapping[str, Mart] = SQL_MARTS,
    r_marts: Mapping[str, Mart] = R_MARTS,
    land_raw: bool = True,
) -> dict[str, str]:
    """Land the raw input once as month-partitioned Parquet (the typed table
    of the load step), so the three reads that follow - the key table, the
    key-mode cleaning and the row-mode cleaning - are columnar and pruned
    instead of three parses of the source files. Then per profile: land the
    cleaned table (interim), summarise it in one scan (interim, a few
    thousand rows), and write every mart (marts): count / mean marts from
    the summary, trip-level marts from the table. Returns name -> path.

    All of it is written under ``<root>/_staging/<run>`` and moved into the zones when
    everything is there, so a run that fails leaves the zones as they were. The run's
    staging and scratch folders are removed in either case."""
    staging = f"{root.rstrip('/')}/_staging/{uuid.uuid4().hex[:12]}"
    try:
        with run_scratch(spark):
            staged = _build(spark, raw, staging, sql_marts, r_marts, land_raw)
        paths = {}
        for name, (zone, path) in staged.items():
            paths[name] = zone_path(root, zone, name)
            publish(spark, path, paths[name])
    finally:
        remove(spark, staging)
    return paths


def _build(spark, raw, staging, sql_marts, r_marts, land_raw) -> dict[str, tuple[str, str]]:
    """Every table of the job under ``staging``: name -> (zone, path)."""
    out: dict[str, tuple[str, str]] = {}

    def place(zone: str, name: str) -> str:
        out[name] = (zone, zone_path(staging, zone, name))
        return out[name][1]

    if land_raw:
        path = place("interim", "raw_typed")
        write_typed(raw.withColumn("period", period_of_start("started_at")), path)
        raw = spark.read.parquet(path).drop("period")
    for name, profile, marts in (("trips_sql", SQL, sql_marts), ("trips_r", R, r_marts)):
        if not marts:
            continue
        trips = land_clean(raw, place("interim", name), profile)
        path = place("interim", name.replace("trips", "summary"))
        trip_summary(trips).write.mode("overwrite").parquet(path)
        summary = spark.read.parquet(path)
        for mart, fn in marts.items():
            df = fn(spark, trips, None) if mart in TRIP_LEVEL else fn(spark, summary, W)
            df.write.mode("overwrite").parquet(place("marts", mart))
        for mart, (source, fn) in DERIVED.items():
            if source in marts:
                fn(spark.read.parquet(out[source][1])).write.mode("overwrite").parquet(place("marts", mart))
    return out


def main(argv: list[str] | None = None) -> None:
    """``python -m tripmart.plans.pipeline --raw <dir> --root <dir>`` (or
    ``spark-submit --py-files tripmart.zip tripmart/plans/pipeline.py ...``):
    read every monthly CSV under ``--raw`` (explicit schema, one scan) and
    run the whole job into ``--root``. The session is the cluster's own
    (``getOrCreate``); ``spark.checkpoint.dir`` must name shared storage."""
    import argparse

    from tripmart.schema import RAW_DOUBLES
    from tripmart.session import apply_scale_conf, ensure_checkpoint_dir
    from tripmart.sources.csv import read_trips

    ap = argparse.ArgumentParser(prog="tripmart.plans.pipeline")
    ap.add_argument("--raw", required=True, help="folder of monthly trip CSV files")
    ap.add_argument("--root", required=True, help="output root (interim/ and marts/ are created under it)")
    ap.add_argument("--glob", default="*.csv")
    ap.add_argument("--scale-conf", action="store_true", help="apply SCALE_CONF where the cluster left a setting unset")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("tripmart-pipeline").getOrCreate()
    ensure_checkpoint_dir(spark)
    if args.scale_conf:
        apply_scale_conf(spark)
    for name, path in sorted(run_pipeline(spark, read_trips(spark, args.raw, RAW_DOUBLES, args.glob), args.root).items()):
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
