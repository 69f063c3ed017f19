"""Hand-made edge rows (FIXTURES.md section 5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripmart.functions.text import strip_whitespace, title_case, trim_spaces
from tripmart.functions.time import day_name, hour_label, minutes_between, minutes_fractional, month_name, parse_mdy_hm, parse_timestamp, weekday_number
from tripmart.operators import clean as C
from tripmart.operators.aggregate import count_rows, histogram, rollup_coalesced, rollup_labeled
from tripmart.operators.join import band_case, band_join
from tripmart.operators.order import field_position, level_rank
from tripmart.schema import BANDS

T = dt.datetime


def _ts(spark, pairs):
    return spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")


def test_partial_and_negative_minutes(spark):
    df = _ts(spark, [(T(2022, 1, 1, 10, 0, 30), T(2022, 1, 1, 10, 1, 20)), (T(2022, 1, 1, 10, 1, 20), T(2022, 1, 1, 9, 59, 30))])
    rows = df.select(minutes_between("a", "b").alias("w"), minutes_fractional("a", "b").alias("f")).collect()
    assert rows[0]["w"] == 0 and rows[0]["f"] == pytest.approx(50 / 60)
    assert rows[1]["w"] == -1


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago"])
def test_dst_gap_is_wall_clock(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(
            [("3/13/2022 1:30", "3/13/2022 3:30"), ("3/13/2022 2:30", "3/13/2022 3:30"), ("11/6/2022 1:30", "11/6/2022 2:30")],
            "a string, b string",
        )
        out = df.select(parse_timestamp("a").alias("a"), parse_timestamp("b").alias("b"))
        rows = out.select(
            "a", minutes_between("a", "b").alias("m"), minutes_fractional("a", "b").alias("f"),
            hour_label("a").alias("h"), day_name("a").alias("d"), month_name("a").alias("mo"),
        ).collect()
        assert [r["m"] for r in rows] == [120, 60, 60]
        assert [r["f"] for r in rows] == [120.0, 60.0, 60.0]
        assert rows[1]["a"] == T(2022, 3, 13, 2, 30)
        assert [r["h"] for r in rows] == ["1 AM", "2 AM", "1 AM"]
        assert rows[1]["d"] == "Sunday" and rows[1]["mo"] == "March"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_parse_variants_never_raise(spark):
    nine = T(2022, 1, 2, 3, 4)
    # text -> as the SQL script's format reads it, as the R script's parser reads it
    cases = {
        "1/2/2022 3:04": (nine, nine), "01/02/2022 03:04": (nine, nine), " 1 / 2/2022   3 : 04 ": (nine, nine), "1/2/2022 3:04:05": (nine, None),
        "1/2/2022 3:04 CST": (nine, None), "1/2/22 3:04": (nine, nine), "1/2/69 3:04": (T(2069, 1, 2, 3, 4), T(1969, 1, 2, 3, 4)), "1/2/70 3:04": (T(1970, 1, 2, 3, 4),) * 2,
        "1-2-2022 3.04": (None, nine), "1.2.22, 3h04": (None, None), "(1/2/2022 3:04)": (None, nine), "1/2/20223:04": (nine, None),
        "": (None, None), "garbage": (None, None), None: (None, None), "2/30/2022 1:00": (None, None), "13/1/2022 1:00": (None, None),
        "1/2/2022 24:00": (None, None), "1/2/2022": (None, None), "2022-01-02 03:04": (None, None), "x1/2/2022 3:04": (None, None),
    }
    df = spark.createDataFrame([(v,) for v in cases], "s string")
    got = {r.s: (r.a, r.b) for r in df.select("s", parse_timestamp("s").alias("a"), parse_mdy_hm("s").alias("b")).collect()}
    assert got == cases


def test_null_key_survives_anti_join(spark):
    df = spark.createDataFrame([(None, "x"), ("a", "y"), ("b", "z")], "ride_id string, v string")
    bad = spark.createDataFrame([("a",), (None,)], "ride_id string")
    got = sorted((r["ride_id"] or "-", r["v"]) for r in C.anti_join(df, bad).collect())
    assert got == [("-", "x"), ("b", "z")]


def test_delete_by_key_vs_row(spark):
    df = spark.createDataFrame([("k", "x"), ("k", ""), ("j", "y"), (None, "")], "ride_id string, v string")
    flagged = C.missing_predicate(df.select("v"))
    key = C.delete_by_key(df, flagged)
    row = df.filter(~C.missing_predicate(df))
    assert sorted((r[0] or "-", r[1]) for r in key.collect()) == [("-", ""), ("j", "y")]
    assert sorted(r[0] for r in row.collect()) == ["j", "k"]


def test_null_group_key_under_rollup(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "k string")
    lab = rollup_labeled(df, ["k"], [count_rows("n")], {"k": "all"})
    got = sorted((r["k"] or "-", r["n"]) for r in lab.collect())
    assert got == [("-", 2), ("a", 1), ("all", 4), ("b", 1)]
    coal = rollup_coalesced(df, "k", [count_rows("n")], "all")
    assert sorted((r["k"], r["n"]) for r in coal.collect()) == [("a", 1), ("all", 2), ("all", 4), ("b", 1)]


def test_midnight_and_noon_labels(spark):
    df = spark.createDataFrame([(T(2022, 1, 1, 0, 5),), (T(2022, 1, 1, 12, 0),), (T(2022, 1, 1, 13, 0),)], "t timestamp_ntz")
    rows = df.select(hour_label("t").alias("u"), hour_label("t", padded=True).alias("p")).collect()
    assert [(r.u, r.p) for r in rows] == [("12 AM", "12 AM"), ("12 PM", "12 PM"), ("1 PM", "01 PM")]


def test_band_case_fall_through(spark):
    open_bands = [("short rides", 1, 10), ("medium rides", 11, 20), ("long rides", 21, None)]
    df = spark.createDataFrame([(10.5,), (10.0,), (0.5,), (25.0,)], "x double")
    got = [r[0] for r in df.select(band_case("x", open_bands)).collect()]
    assert got == ["Other", "short rides", "Other", "long rides"]


def test_band_join_inclusive_and_drops_outside(spark):
    df = spark.createDataFrame([(1,), (10,), (11,), (99999,), (100000,), (0,)], "m bigint")
    got = sorted((r["m"], r["name"]) for r in band_join(df, "m", BANDS).collect())
    assert got == [(1, "short rides"), (10, "short rides"), (11, "medium rides"), (99999, "long rides")]


def test_title_case(spark):
    df = spark.createDataFrame([("classic_bike",), ("N. CLARK st",), ("foo-bar",), ("fountain (temp)",), ("o'hare 8th",), ("d.c. hall",), ("a.1b x..y",)], "s string")
    assert [r[0] for r in df.select(title_case("s")).collect()] == ["Classic_bike", "N. Clark St", "Foo-Bar", "Fountain (Temp)", "O'hare 8th", "D.c. Hall", "A.1b X..Y"]


def test_trim_variants(spark):
    df = spark.createDataFrame([("\t a b  ",), ("  x  ",)], "s string")
    rows = df.select(trim_spaces("s").alias("t"), strip_whitespace("s").alias("w")).collect()
    assert rows[0]["t"] == "\t a b  " and rows[0]["w"] == "a b"
    assert rows[1]["t"] == "x" and rows[1]["w"] == "x"


def test_histogram_gap_fill(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (4.0,)], "x double")
    got = sorted(tuple(r) for r in histogram(df, "x").collect())
    assert got == [(1, 2), (2, 0), (3, 0), (4, 1)]


def test_histogram_display_range_keeps_data(spark):
    df = spark.createDataFrame([(1.0,), (60.0,), (0.6,)], "x double")
    got = sorted(tuple(r) for r in histogram(df, "x", 1.0, 0, 3).collect())
    assert got == [(1, 2), (2, 0), (3, 0)]


def test_histogram_of_a_huge_range(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2e9,), (-1e9,), (None,)], "x double")
    got = sorted(tuple(r) for r in histogram(df, "x", 1.0, 0, 4).collect())
    assert got == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)]
    wide = histogram(df, "x")  # a distributed range, not one array in one task
    assert "Range (-1000000000, 2000000001" in wide._jdf.queryExecution().executedPlan().toString()
    assert histogram(df.where("x > 1e10"), "x").collect() == []


def test_label_not_in_list(spark):
    df = spark.createDataFrame([("z",), ("b",), (None,)], "s string")
    rows = df.select(field_position("s", ["a", "b"]).alias("f"), level_rank("s", ["a", "b"]).alias("l")).collect()
    assert [(r.f, r.l) for r in rows] == [(0, None), (2, 2), (0, None)]


def test_weekday_number_monday_zero(spark):
    df = spark.createDataFrame([(T(2022, 1, 3, 8, 0),), (T(2022, 1, 9, 8, 0),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(weekday_number("t")).collect()] == [0, 6]


def test_decimal_out_of_range_is_null(spark):
    df = spark.createDataFrame([("123.4",), ("41.8",)], "s string")
    got = [r[0] for r in df.select(F.col("s").try_cast("decimal(12,10)")).collect()]
    assert got[0] is None and float(got[1]) == 41.8


def test_charset_trim_equals_regex_trim(spark):
    from tripmart.functions.text import WHITE_SPACE, strip_whitespace_regex

    ws = WHITE_SPACE
    vals = [ws + "a" + ws + "b" + ws, "\u00a0x\u3000", "  y", "z\t", "", ws, None, "\u200bkeep\u200b"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    rows = df.select(strip_whitespace("s").alias("a"), strip_whitespace_regex("s").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert rows[0].a == "a" + ws + "b" and rows[1].a == "x" and rows[7].a == "\u200bkeep\u200b"
