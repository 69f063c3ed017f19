"""Row-mode cleaning as a stream over arriving monthly files equals the batch result."""

import pytest

from conftest import SF_SMALL
from tripmart.fixtures import raw_trips
from tripmart.operators import clean as C
from tripmart.sources import csv as S
from tripmart.sources.tables import period_of_start
from tripmart.streaming import clean_stream, land_trips


def test_stream_landing_matches_batch(spark, tmp_path):
    raw = raw_trips(spark, SF_SMALL)
    src = str(tmp_path / "incoming")
    S.write_csv(raw.withColumn("period", period_of_start("started_at")), src, partition_by=["period"])
    out, ckpt = str(tmp_path / "landed"), str(tmp_path / "ckpt")
    # flat folder of files, as the monthly drops arrive
    files = spark.read.text(src).inputFiles()
    flat = str(tmp_path / "flat")
    import os
    import shutil

    os.makedirs(flat)
    for i, f in enumerate(sorted(files)):
        shutil.copy(f.replace("file://", ""), os.path.join(flat, f"Bike_Data_{i:06d}.csv"))
    q = land_trips(spark, flat, out, ckpt)
    q.awaitTermination(120)
    landed = spark.read.parquet(out).drop("period")
    batch = C.clean_trips(S.read_trips(spark, flat), C.R)
    assert landed.count() == batch.count() == 909
    assert landed.exceptAll(batch.select(*landed.columns)).count() == 0


def test_key_mode_is_batch_only(spark):
    with pytest.raises(ValueError):
        clean_stream(raw_trips(spark, SF_SMALL), C.SQL)
