"""Plan-shape checks: what Spark will actually run."""

import pytest

from conftest import SF_SMALL
from tripmart.fixtures import raw_trips
from tripmart.operators import clean as C
from tripmart.plans import catalog as K


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for k, fn in K.QUERIES.items():
        if k.startswith("s0") or k.startswith("s1"):
            continue  # source keys write files while building; their reads are checked in test_sources
        out[k] = plan(fn(spark, SF_SMALL))
    return out


def test_no_python_in_any_plan(plans):
    for k, p in plans.items():
        for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
            assert node not in p, (k, node)


def test_no_cartesian_products(plans):
    for k, p in plans.items():
        assert "CartesianProduct" not in p, k


def test_nested_loop_join_only_for_the_band_join(plans):
    with_bnlj = {k for k, p in plans.items() if "BroadcastNestedLoopJoin" in p}
    assert with_bnlj == {"j01_band_join", "m06_band_rollup"}


def test_key_mode_moves_candidates_only(spark, monkeypatch):
    """Whatever the size and with every broadcast off, trips whose id is not
    contested are never exchanged; only the candidates written aside are."""
    parts = []
    split = C._split
    monkeypatch.setattr(C, "_split", lambda *a: parts.append(split(*a)) or parts[-1])
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    raw = raw_trips(spark, SF_SMALL)
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        assert C.clean_trips(raw, C.SQL).count() == 908
        df = C.rename_raw(raw)
        C.delete_by_key(df, C.missing_predicate(df))
        C.anti_join(df, df.where("ride_id LIKE '%7'"))
        for sure, _ in parts:
            assert "Exchange" not in plan(sure) and "Join" not in plan(sure)
        assert [c.count() for _, c in parts[:2]] == [3, 1]  # not the 76 flagged ids
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_row_mode_has_no_exchange(spark):
    p = plan(C.clean_trips(raw_trips(spark, SF_SMALL), C.R))
    assert "Exchange" not in p


def formatted(df) -> str:
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_filters_reach_the_landed_scan(spark):
    K.use_landed_raw(spark, SF_SMALL)
    try:
        p = formatted(K.QUERIES["m16_popular_routes"](spark, SF_SMALL))
        assert "PushedFilters: [IsNotNull(ride_id), Not(EqualTo(ride_id,))" in p
        scan = p.split("ReadSchema:")[1].split("\n")[0]
        assert "period" not in scan  # the partition column is pruned
        p = formatted(K.QUERIES["m02_min_length"](spark, SF_SMALL))
        assert "Subquery" in p and "PushedFilters" in p
    finally:
        K._LANDED.pop(SF_SMALL, None)


def test_partial_aggregation_before_every_shuffle(plans):
    for k in ("m01_avg_by_user", "m07_month_rollup", "m16_popular_routes", "q01_duplicates_sql_key"):
        assert "partial_" in plans[k], k


def test_each_query_scans_the_trip_table_once(spark):
    """On a landed raw table (no adapter union), every registered query's
    final plan reads it at most once; small intermediates (key tables,
    histogram counts) are written once and read back instead."""
    path = K.use_landed_raw(spark, SF_SMALL)
    name = path.rstrip("/").split("/")[-1]
    try:
        for k, fn in K.QUERIES.items():
            if k[:2] in ("s0", "s1"):
                continue
            p = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            assert p.count(name) <= 1, k
    finally:
        K._LANDED.pop(SF_SMALL, None)
