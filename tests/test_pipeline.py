"""The production job writes the same marts the registry computes."""

import pytest

from conftest import SF_MID, SF_SMALL
from oracle_compare import rows_key
from tripmart.plans import catalog as K
from tripmart.plans.pipeline import DERIVED, R_MARTS, SQL_MARTS, run_pipeline


@pytest.mark.parametrize("sf", [SF_MID])
def test_pipeline_marts_equal_registry(spark, tmp_path, sf):
    paths = run_pipeline(spark, K.raw(spark, sf), str(tmp_path))
    assert set(SQL_MARTS) | set(R_MARTS) | set(DERIVED) <= set(paths)
    pairs = {
        "avg_by_user": "m01_avg_by_user", "min_length": "m02_min_length", "max_length": "m03_max_length",
        "avg_by_weekday": "m04_avg_by_weekday", "count_by_weekday": "m05_count_by_weekday",
        "band_rollup": "m06_band_rollup", "month_rollup": "m07_month_rollup", "top_routes": "m08_top_routes",
        "hour_rollup": "m09_hour_rollup", "avg_by_user_r": "a13_grand_total", "avg_by_weekday_r": "a15_pivot_wide",
        "count_by_weekday_r": "a15_pivot_wide_counts", "band_cube": "m06_band_cube", "month_cube": "m07_month_cube",
        "hour_rollup_padded": "m09_hour_padded", "user_bike_tree": "m10_user_bike_tree",
        "length_histogram": "m11_length_histogram", "monthly_trend": "m12_monthly_trend", "weekday_bars": "m13_weekday_bars",
        "hour_heatmap": "m14_hour_heatmap", "daytype_share": "m15_daytype_share", "popular_routes": "m16_popular_routes",
        "map_routes": "m17_map_routes",
    }
    assert set(pairs) == set(SQL_MARTS) | set(R_MARTS) | set(DERIVED)
    for mart, key in pairs.items():
        a = spark.read.parquet(paths[mart])
        b = K.QUERIES[key](spark, sf)
        cols = sorted(b.columns)
        assert sorted(a.columns) == cols, mart
        assert rows_key(a.select(*cols).collect()) == rows_key(b.select(*cols).collect()), mart


def test_summary_is_bounded_and_complete(spark):
    from tripmart.operators import clean as C
    from tripmart.plans.summary import trip_summary

    trips = C.clean_trips(K.raw(spark, SF_MID), C.R)
    summary = trip_summary(trips)
    # bounded by the attribute domains (user x bike x month x weekday x hour x
    # band combinations), whatever the number of trips
    assert summary.count() <= 2 * 3 * 12 * 7 * 24 * 5
    assert summary.agg({"_n": "sum"}).first()[0] == trips.count()


def test_pipeline_command_line(spark, tmp_path):
    from tripmart.plans.pipeline import main
    from tripmart.sources import csv as S
    from tripmart.sources.tables import period_of_start

    raw_dir, root = str(tmp_path / "raw"), str(tmp_path / "out")
    S.write_csv(K.raw(spark, "/root/testdata/sf0.001").withColumn("period", period_of_start("started_at")), raw_dir, partition_by=["period"])
    main(["--raw", raw_dir, "--root", root])
    got = spark.read.parquet(f"{root}/marts/month_rollup").count()
    assert got == 37


def test_land_clean_equals_clean_trips_with_broadcast_off(spark, tmp_path):
    from tripmart.operators import clean as C
    from tripmart.plans.pipeline import land_clean

    raw = K.raw(spark, SF_MID)
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        landed = land_clean(raw, str(tmp_path / "t"), C.SQL)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    direct = C.clean_trips(raw, C.SQL)
    cols = direct.columns
    assert landed.select(*cols).exceptAll(direct).count() == 0 and direct.exceptAll(landed.select(*cols)).count() == 0


def test_audit_rides_along_with_the_write(spark, tmp_path):
    from pyspark.sql import Observation

    from tripmart.operators import clean as C

    raw = K.raw(spark, SF_SMALL)
    for profile in (C.R, C.SQL):
        seen = Observation()
        C.clean_trips(raw, profile, audit=seen).write.parquet(str(tmp_path / profile.mode))
        report = {f"{r.step}/{r.column_name}": r.changed for r in C.value_audit(raw, profile).collect()}
        assert seen.get == report and report["trim/start_sta_name"] > 0 and report["unread/started_at"] == 0


def test_a_failed_run_leaves_the_zones_and_no_scratch(spark, tmp_path):
    import os

    import pytest

    from tripmart.plans import pipeline as P
    from tripmart.session import ensure_checkpoint_dir

    root, raw = str(tmp_path / "out"), K.raw(spark, SF_SMALL)
    scratch = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(scratch))
    few = {"avg_by_user": P.SQL_MARTS["avg_by_user"], "top_routes": P.SQL_MARTS["top_routes"]}
    paths = P.run_pipeline(spark, raw, root, few, {})
    want = sorted(map(tuple, spark.read.parquet(paths["top_routes"]).collect()))
    assert want and set(os.listdir(scratch)) == before and os.listdir(f"{root}/_staging") == []

    def broken(s, t, w):
        raise RuntimeError("no such mart")

    with pytest.raises(RuntimeError):
        P.run_pipeline(spark, raw.limit(3), root, {**few, "broken": broken}, {})
    assert sorted(map(tuple, spark.read.parquet(paths["top_routes"]).collect())) == want
    assert set(os.listdir(scratch)) == before and os.listdir(f"{root}/_staging") == []
    P.run_pipeline(spark, raw.limit(3), root, few, {})  # a later run takes their place
    assert sorted(map(tuple, spark.read.parquet(paths["top_routes"]).collect())) != want
