"""Properties across operators."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tripmart.fixtures import raw_trips
from tripmart.operators import clean as C
from tripmart.plans import marts as M


@pytest.fixture(scope="module")
def raw(spark):
    return raw_trips(spark, SF_SMALL).cache()


def test_folded_key_mode_equals_stepwise(raw):
    a = C.clean_trips(raw, C.SQL)
    b = C.clean_trips_stepwise(raw, C.SQL)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_folded_key_mode_with_padded_colliding_ids(spark):
    rows = [
        (" k", "x", "1/1/2022 1:00", "1/1/2022 1:30"),
        ("k", "", "1/1/2022 1:00", "1/1/2022 1:30"),  # missing: deletes raw id 'k' only
        ("j ", "x", "1/1/2022 1:00", "1/1/2022 1:00"),  # short: deletes trimmed id 'j'
        ("j", "x", "1/1/2022 2:00", "1/1/2022 2:30"),
        (None, "x", "1/1/2022 1:00", "1/1/2022 1:00"),
        ("m", "x", "1/1/2022 3:00", "1/1/2022 3:30"),
    ]
    df = spark.createDataFrame(rows, "ride_id string, rideable_type string, started_at string, ended_at string")
    for c in ["start_station_name", "start_station_id", "end_station_name", "end_station_id", "member_casual"]:
        df = df.withColumn(c, F.lit("s"))
    for c in ["start_lat", "start_lng", "end_lat", "end_lng"]:
        df = df.withColumn(c, F.lit(41.8).cast("decimal(12,10)"))
    a = C.clean_trips(df, C.SQL)
    b = C.clean_trips_stepwise(df, C.SQL)
    assert sorted(r.ride_id or "-" for r in a.collect()) == sorted(r.ride_id or "-" for r in b.collect()) == ["-", "k", "m"]


def test_idempotent_cleaning_steps(raw):
    ren = C.rename_raw(raw)
    once = C.trim_text(C.drop_missing(ren, "row"), "whitespace")
    twice = C.trim_text(C.drop_missing(once, "row"), "whitespace")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_row_mode_contains_key_mode(raw):
    key = C.clean_trips(raw, C.Profile(mode="key"))
    row = C.clean_trips(raw, C.Profile(mode="row"))
    assert key.select("ride_id", "started_at").exceptAll(row.select("ride_id", "started_at")).count() == 0


def test_rollup_details_sum_to_total(raw):
    trips = C.clean_trips(raw, C.SQL)
    rows = M.count_by_weekday(trips).collect()
    total = [r for r in rows if r["user_type"] == "combined"][0]
    detail = [r for r in rows if r["user_type"] != "combined"]
    assert sum(r["grand_total"] for r in detail) == total["grand_total"]
    assert sum(total[f"num_rides_{d.lower()}"] for d in M.WEEKDAYS) == total["grand_total"]


def test_cube_contains_rollup(raw):
    trips = C.clean_trips(raw, C.SQL)
    roll = {(r[0], r[2]) for r in M.month_rollup(trips).collect()}
    cube = M.month_cube(trips).collect()
    assert len(cube) == len(roll) + 2  # plus the per-user-type yearly totals


def test_shares_sum_to_100(raw):
    trips = C.clean_trips(raw, C.R)
    out = M.daytype_share(trips).groupBy("user_type").agg(F.sum("prop").alias("s")).collect()
    for r in out:
        assert r["s"] == pytest.approx(100.0)


def test_tree_percentages(raw):
    tree = M.user_bike_tree(C.clean_trips(raw, C.R)).collect()
    by_level = {}
    for r in tree:
        by_level.setdefault(r["level"], []).append(r)
    assert by_level[0][0]["pct_of_parent"] == 100.0
    assert sum(r["pct_of_parent"] for r in by_level[1]) == pytest.approx(100.0)
    assert {r["bike_type"] for r in by_level[2]} == {"Classic", "Docked", "Electric"}


def test_global_sort_is_sorted(raw):
    trips = C.clean_trips(raw, C.R)
    vals = [r[0] for r in trips.select("ride_length").orderBy(F.desc("ride_length")).collect()]
    assert vals == sorted(vals, reverse=True)


@pytest.mark.parametrize("everything", [False, True])
def test_key_deletes_at_any_bitmap(spark, monkeypatch, everything):
    """Random padded, colliding and NULL ids: the folded plan equals the
    literal one step after the other, also if every row is a candidate."""
    import random

    if everything:
        monkeypatch.setattr(C, "hash_bitmap", lambda hashes, **_: lambda h: F.lit(True))
    rng = random.Random(5)
    rows = []
    for i in range(400):
        k = rng.choice([None, "", "a", " a", "a ", "b", " b ", *[f"k{j}" for j in range(60)]])
        rows.append((k, rng.choice(["x", "x", "x", None, ""]), f"1/1/2022 10:{rng.randrange(10, 20)}", "1/1/2022 10:20" if rng.random() < 0.8 else "1/1/2022 10:10"))
    raw = spark.createDataFrame(rows, "ride_id string, rideable_type string, started_at string, ended_at string")
    for p in (C.SQL, C.R.with_(mode="key")):
        got, want = C.clean_trips(raw, p), C.clean_trips_stepwise(raw, p)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect())) and 0 < got.count() < 380
    bad = [r for r in rows if not r[1]]
    out = C.delete_by_key(raw, F.col("rideable_type").isNull() | (F.col("rideable_type") == "")).collect()
    gone = {r[0] for r in bad if r[0] is not None}
    assert sorted(repr(tuple(r)) for r in out) == sorted(repr(r) for r in rows if r[0] not in gone)
    keys = spark.createDataFrame([("a",), ("zz",), (None,), ("k1",), ("k1",)], "ride_id string")
    assert sorted(repr(tuple(r)) for r in C.anti_join(raw, keys).collect()) == sorted(repr(r) for r in rows if r[0] not in ("a", "k1"))
    audit = [tuple(r)[2:] for r in C.key_clean_audit(raw, C.SQL).collect()]
    missing = C.delete_by_key(C.rename_raw(raw), C.missing_predicate(C.rename_raw(raw))).count()
    assert audit == [(400, 400), (400, missing), (missing, missing), (missing, missing), (missing, C.clean_trips(raw, C.SQL).count())]


@pytest.mark.parametrize("everything", [False, True])
def test_duplicates_are_exact(spark, raw, monkeypatch, everything):
    from tripmart.operators import quality
    from tripmart.operators.quality import duplicates

    if everything:
        monkeypatch.setattr(quality, "hash_bitmap", lambda hashes, **_: lambda h: F.lit(True))
    df = C.r_stage_parsed(raw)
    keys = ["ride_id", "bike_type", "started_at", "ended_at", "start_sta_name", "end_sta_name"]
    a = duplicates(df, keys, "n")
    b = df.groupBy(*keys).count().where("count > 1").withColumnRenamed("count", "n")
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # NULL parts of a key still group together
    t = spark.createDataFrame([("a", None), ("a", None), (None, "a"), ("b", "c")], "x string, y string")
    got = sorted((r.x or "-", r.y or "-", r.n) for r in duplicates(t, ["x", "y"], "n").collect())
    assert got == [("a", "-", 2)]
