"""Operator 2 [native]: proportional stratified interleaving into shards.

Rows are put in a seeded random order within each source; a row's place in its
source, as a fraction of the source's rows, is its place in the whole; the
whole is cut into shards whose row counts differ by at most one. Every shard
then holds each source in the mixture's proportion.

Both orders are found without sorting a source or the whole in one task: rows
fall into small ranges of the seeded hash (or of the fraction), counts per range
are summed before the shuffle, running totals over ranges run in two levels,
and only rows of one range are numbered together. A source with a third of all
rows therefore has a third of all ranges.

Defined results: null text has size 1 and the CRC of the empty text; a null
source is a source of its own; repeated rows are rows; an empty table gives an
empty result; ``doc_id`` may be null or repeated (ties fall to size and CRC, then
rows are equal and interchangeable); other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.llm.tables import whole_text

#: Rows of one range, on average.
RANGE_ROWS = 1000

#: Ranges whose running totals are made together.
BLOCK = 4096

#: Copies of a source's count, so that rows of one source meet it in many tasks.
SALTS = 64


def _before(counts: DataFrame, by: list[str], at: str, n: str, out: str) -> DataFrame:
    """``out``: sum of ``n`` over smaller ``at`` within ``by``. Totals run over
    blocks of ranges, then inside each block, so no task holds all ranges."""
    blocks = counts.groupBy(*by, F.floor(F.col(at) / BLOCK).alias("_block")).agg(F.sum(n).alias("_all"))
    upto = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_all").over(upto), F.lit(0))).drop("_all")
    inner = Window.partitionBy(*by, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = counts.withColumn("_block", F.floor(F.col(at) / BLOCK))
    own = own.withColumn("_in", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    return own.join(blocks, [*by, "_block"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in", "_block")


def _ranges(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / size)).cast("long")


def interleave(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: ``id_col, size, text_crc32, law, shard, slot,
    grown_shard`` (law ``rows``: shard counts differ by at most one)."""
    text = whole_text(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_src"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    # 53 bits of the seeded hash as a fraction in [0, 1)
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    part = F.shiftrightunsigned("_h", 11) / F.lit(float(2**53))
    per_source = rows.groupBy("_src").agg(F.count(F.lit(1)).alias("_n"))
    # a source may hold a third of all rows: its count is met under many salts
    salts = F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("_salt")
    rows = rows.withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    rows = rows.join(per_source.select("_src", "_n", salts), ["_src", "_salt"]).drop("_salt")
    rows = rows.withColumn("_r", F.floor(part * _ranges(F.col("_n"), range_rows)))

    # place within the source
    counts = rows.groupBy("_src", "_r").agg(F.count(F.lit(1)).alias("_c"))
    offsets = _before(counts, ["_src"], "_r", "_c", "_off").drop("_c")
    nth = F.row_number().over(Window.partitionBy("_src", "_r").orderBy("_h", "doc_id", "size", "text_crc32"))
    rows = rows.withColumn("_k", nth).join(offsets, ["_src", "_r"])
    rows = rows.withColumn("_place", F.col("_off") + F.col("_k"))
    rows = rows.withColumn("_f", (F.col("_place") - F.lit(0.5)) / F.col("_n")).drop("_r", "_k", "_off", "_n")

    # place in the whole: the ranges now cut the fraction
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("_r", F.floor(F.col("_f") * _ranges(F.col("_total"), range_rows)))
    counts = rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_c")).withColumn("_whole", F.lit(0))
    offsets = _before(counts, ["_whole"], "_r", "_c", "_off").select("_r", "_off")
    nth = F.row_number().over(Window.partitionBy("_r").orderBy("_f", "_src", "_place"))
    rows = rows.withColumn("_k", nth).join(offsets, "_r")
    place = F.col("_off") + F.col("_k") - 1

    # cut: shard s holds places [ceil(s * total / shards), ceil((s + 1) * total / shards))
    rows = rows.withColumn("_at", place).withColumn("shard", F.floor(F.col("_at") * shards / F.col("_total")).cast("int"))
    start = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return rows.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_at") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write rows with a ``shard`` column as one folder per shard, in slot order
    within each file; a shard is dealt over several tasks by slot ranges."""
    (assigned.withColumn("_part", F.floor(F.col("slot") / 100_000)).repartition("shard", "_part")
     .sortWithinPartitions("shard", "slot").drop("_part").write.partitionBy("shard").parquet(path))

