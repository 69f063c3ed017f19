"""Small shared helpers: table access, null text, lossless scratch tables and
connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read with Spark's reader (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns whose names the operator writes itself, so an
    extra column of that name neither clashes nor leaks into the result."""
    own = {n.lower() for n in names}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own])


def positional(docs: DataFrame) -> DataFrame:
    """``docs`` with columns ``c0, c1, ...``: whatever their names, they don't clash with
    an operator's working columns. ``place`` finds a column, ``named`` gives the names back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """Positional name of the column that ``name`` means in ``docs``."""
    exact = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
    return f"c{exact[0]}"


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The positional columns of ``rows`` under the names of ``docs``, nothing else."""
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: one row ``(node, root)``
    per node that has an edge, ``root`` the smallest node reachable.

    Alternating large-star and small-star steps: every step is a min per node
    (combined before the shuffle) and an equi-join back, so a node that holds a
    third of all edges is a skewed join side that adaptive execution splits.
    Edges are written after every round (shared checkpoint folder), which cuts
    the lineage; only one count and one checksum reach the driver."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.join(low, "u")
        if large:
            return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = low.where("m < u").select("u", F.col("m").alias("v"))
        return hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        e = materialize(star(star(e, True), False), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
