"""A set of hashes as one row of fixed size, tested per row without a join.

A bitmap is built by a partially aggregated ``bit_or`` and read by a scalar
subquery. Its size follows the session's number of shuffle partitions (how large the
cluster expects its tables to be), not the data, and is 8 MB at most. A row whose bit is clear is surely not in the set; a row whose bit is set is a
candidate that an exact step has to decide. The more hashes, the more rows are
candidates; nothing else changes with size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.session import materialize

#: Bits of the bitmap per shuffle partition and at most, as powers of two.
PER_PARTITION, MOST = 14, 26


def bitmap_bits(shuffle_partitions: int) -> int:
    """Size of the bitmap as a power of two."""
    return min(MOST, PER_PARTITION + max(1, shuffle_partitions - 1).bit_length())


def hash_bitmap(hashes: DataFrame, name: str = "_h", bits: int | None = None) -> Callable[[Column], Column]:
    """Test for membership of a 64-bit hash in ``hashes[name]`` (no row is lost, some
    strangers pass). The bitmap is written once to the shared checkpoint folder."""
    bits = bits or bitmap_bits(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = 1 << (bits - 6)  # of 64 bits

    def word(h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - (bits - 6)).cast("int")

    own = hashes.select(F.col(name).alias("_h"))
    set_words = own.select(word(F.col("_h")).alias("i"), F.expr("shiftleft(1L, CAST(_h & 63L AS int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    every = hashes.sparkSession.range(0, words, 1, 1).select(F.col("id").cast("int").alias("i"))
    full = every.join(F.broadcast(set_words), "i", "left").select("i", F.coalesce("b", F.lit(0)).alias("b"))  # at most ``words`` rows
    row = full.agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("s")).select(F.transform("s", lambda x: x["b"]).alias("words"))
    bitmap = materialize(row, "bitmap").scalar()

    def holds(h: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.get(bitmap, word(h)), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return holds
