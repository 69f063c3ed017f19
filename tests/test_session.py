"""Session helpers: scratch materialisation, scale settings."""

from tripmart.session import SCALE_CONF, apply_scale_conf, ensure_checkpoint_dir, materialize


def test_materialize_counts_during_write(spark):
    df = spark.range(1234).selectExpr("id % 7 AS k")
    back, n = materialize(df, "t-count", with_count=True)
    assert n == 1234 and back.count() == 1234
    assert ensure_checkpoint_dir(spark).rstrip("/") in back.inputFiles()[0]


def test_scale_conf_keeps_cluster_values(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    done = apply_scale_conf(spark)
    try:
        assert spark.conf.get("spark.sql.shuffle.partitions") == before  # set by the session builder
        assert set(done) <= set(SCALE_CONF)
    finally:
        for k in done:
            spark.conf.unset(k)


def test_inferred_read_widens_to_schema(spark, tmp_path):
    import os

    from pyspark.sql import types as T

    from tripmart.sources.csv import read_inferred

    d = tmp_path / "inf"
    os.makedirs(d)
    (d / "a.csv").write_text("id,v\n1,2.5\n")
    (d / "b.csv").write_text("id,v\n2,x\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.DoubleType())])
    rows = sorted(tuple(r) for r in read_inferred(spark, str(d), schema).collect())
    assert rows == [("1", 2.5), ("2", None)]
