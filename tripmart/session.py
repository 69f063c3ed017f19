"""Session helpers: a local session for tests and the bench, and a shared
checkpoint location read from the cluster's own configuration."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings the library relies on. Applied to sessions we build; a cluster
# session keeps its own values except where noted in ``ensure_conf``.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Runtime SQL settings for full-scale runs (~100 TB, ~1000 executors): the
# full-table shuffles (duplicate report, global sort, sort-merge fallback of
# the key join) start wide and AQE coalesces small ones; skewed partitions
# of a join are split. Applied only where the session has no value yet.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


def apply_scale_conf(spark: SparkSession, conf: dict[str, str] = SCALE_CONF) -> dict[str, str]:
    """Set each of ``conf`` that the cluster left at its default; returns
    what was set. Cluster-provided values always win."""
    done = {}
    for k, v in conf.items():
        if not spark.conf.isModifiable(k):
            continue
        if spark.sparkContext.getConf().contains(k):
            continue
        spark.conf.set(k, v)
        done[k] = v
    return done


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tripmart") -> SparkSession:
    """Build (or reuse) a local session; the cluster never goes through here."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only in local mode, when it is unset (tests),
    create one; on a cluster an unset folder is an error, never a
    machine-local path."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: scratch tables need a folder every executor can reach "
            "(set spark.checkpoint.dir to shared storage)"
        )
    d = tempfile.mkdtemp(prefix="tripmart-ckpt-")  # local mode only: driver and executors share this machine
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local
    on a cluster, because the folder comes from the cluster's settings)."""
    base = _RUN.get() or ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


#: Scratch folder of the run under way (see ``run_scratch``).
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours in shared storage, if it is there."""
    fs, p = _files(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """Put a written folder in the place of ``final``."""
    fs, source = _files(spark, staged)
    _, target = _files(spark, final)
    fs.mkdirs(target.getParent())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"could not move {staged} to {final}")


@contextmanager
def run_scratch(spark: SparkSession):
    """Scratch tables made inside go to one folder of the shared checkpoint folder,
    removed at the end, also after an error. Frames that read them must have been
    written by then."""
    path = scratch_path(spark, "run")
    mark = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(mark)
        remove(spark, path)


@contextmanager
def shuffles_released(spark: SparkSession):
    """Queries run inside give their shuffle files back as soon as they end, not when
    the driver collects garbage; for frames that are written once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def env_cpus(default: int = 8) -> int:
    try:
        return int(os.environ.get("BENCH_CPUS", default))
    except ValueError:
        return default


def materialize(df, name: str, with_count: bool = False):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    return a DataFrame reading it back: cuts the lineage (an executor lost
    later re-reads the files instead of recomputing) and makes its size
    known. One job; ``Dataset.checkpoint`` would compute the data twice.
    With ``with_count`` the row count is observed during that same write
    (no second job) and returned as well."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    path = scratch_path(df.sparkSession, name)
    if not with_count:
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    obs = Observation(f"{name}-rows-{uuid.uuid4().hex[:8]}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path), int(obs.get["rows"])
