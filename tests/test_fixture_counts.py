"""Expected counts and values written down in FIXTURES.md (sf0.01)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from tripmart.fixtures import raw_trips
from tripmart.operators import clean as C
from tripmart.plans import marts as M


@pytest.fixture(scope="module")
def trips_mid(spark):
    raw = raw_trips(spark, SF_MID)
    return {"raw": raw, "key": C.clean_trips(raw, C.SQL).cache(), "row": C.clean_trips(raw, C.R).cache()}


def test_raw_and_clean_counts(spark, trips_mid):
    assert trips_mid["raw"].count() == 10021
    assert trips_mid["key"].count() == 9033
    assert trips_mid["row"].count() == 9037
    small = raw_trips(spark, SF_SMALL)
    assert small.count() == 1003
    assert C.clean_trips(small, C.SQL).count() == 908
    assert C.clean_trips(small, C.R).count() == 909


def test_m1_values(trips_mid):
    got = {r["user_type"]: r["avg_ride_length_min"] for r in M.avg_by_user(trips_mid["key"]).collect()}
    assert got == {"casual": 182.77, "member": 150.29, "combined": 161.17}


def test_m2_m3(trips_mid):
    assert M.min_length(trips_mid["key"]).first()[0] == 1
    assert M.max_length(trips_mid["key"]).first()[0] == 100500


def test_m6a_values(spark, trips_mid):
    got = {(r[0], r[1]): r[2] for r in M.band_rollup(spark, trips_mid["key"]).collect()}
    assert got[("short rides", "combined")] == 1658
    assert got[("short rides", "casual")] == 525
    assert got[("medium rides", "member")] == 863
    assert got[("long rides", "combined")] == 6069
    assert got[("all rides", "combined")] == 9023
    assert len(got) == 10


def test_m6b_values(trips_mid):
    # the CASE bands on key-mode trips: no upper limit, no 'Other' at minute grain
    got = {(r[0], r[1]): r[2] for r in M.band_cube(trips_mid["key"]).collect()}
    assert got[("long rides", "United")] == 6079
    assert got[("all rides", "United")] == 9033
    assert got[("all rides", "casual")] == 3026
    assert not any(k[0] == "Other" for k in got)
    assert len(got) == 12


def test_m15_values(trips_mid):
    rows = {(r["user_type"], r["day_type"]): r for r in M.daytype_share(trips_mid["key"]).collect()}
    assert rows[("casual", "WKND")]["total"] == 859
    assert rows[("casual", "WKND")]["prop"] == pytest.approx(28.38731, abs=1e-5)
    assert rows[("casual", "WKND")]["ypos"] == pytest.approx(14.19365, abs=1e-5)
    assert rows[("casual", "WKDY")]["ypos"] == pytest.approx(50.0, abs=1e-9)
    assert rows[("member", "WKDY")]["total"] == 4280


def test_cardinalities(trips_mid):
    key, row = trips_mid["key"], trips_mid["row"]
    assert M.month_rollup(key).count() == 37
    assert M.month_cube(row).count() == 39
    assert M.hour_rollup(key).count() == 25
    assert M.hour_rollup_padded(row).count() == 25
    assert M.user_bike_tree(row).count() == 9
    assert M.monthly_trend(row).count() == 24
    assert M.weekday_bars(row).count() == 14
    assert M.hour_heatmap(row).count() == 168
    assert M.popular_routes(row).count() == 10
    assert M.map_routes(row).count() == 10
    assert M.top_routes(key).count() == 10


def test_histogram_full_range_non_empty_bins(trips_mid):
    from tripmart.operators.aggregate import histogram

    h = histogram(trips_mid["row"], "ride_length", 1.0, None, None)
    assert h.filter(F.col("n") > 0).count() == 288
