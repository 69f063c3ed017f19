"""Data-quality reports: duplicate groups, missing values per column and
blank counts. (The per-step row audits of the cleaning chains are one-pass
aggregates in ``operators.clean``.)"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.functions.text import blank_to_null
from tripmart.operators.clean import missing_columns
from tripmart.operators.sketch import hash_bitmap
from tripmart.session import materialize


def duplicates(df: DataFrame, keys: Sequence[str], count_name: str = "n", keep_keys: bool = True) -> DataFrame:
    """Groups of ``keys`` with more than one row (``HAVING COUNT(*) > 1``).

    Nearly every key is unique, so a plain group-by would shuffle the full
    width of every key. The keys are written once; a first pass groups their
    8-byte hashes (partial counts per task) and puts those seen more than once
    in a bitmap of fixed size; only rows whose hash is in it reach the exact
    group-by. Colliding hashes and bits only add candidates, which the exact
    pass removes, so the result is exact and the plan the same at every size."""
    own = materialize(df.select(*keys), "keys")
    h = F.xxhash64(*[F.col(k) for k in keys])
    again = own.select(h.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    own = own.where(hash_bitmap(again.select("_h"))(h))
    out = own.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name)).filter(F.col(count_name) > 1)
    return out if keep_keys else out.select(count_name)


def missing_by_column(df: DataFrame, key: str = "ride_id", name: str = "missing_column") -> DataFrame:
    """One row per (row key, column that is missing in that row): the
    13-branch ``UNION ALL`` of the reference in one scan."""
    return df.select(F.col(key), F.explode(missing_columns(df)).alias(name))


def blank_counts(df: DataFrame, column_name: str = "column_name", count_name: str = "blanks") -> DataFrame:
    """Per text column, how many values are the empty string (turned into
    NULL by the blank-to-NULL step). One aggregate, then unpivot."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    wide = df.agg(*[F.count_if(F.col(c).isNotNull() & blank_to_null(c).isNull()).alias(c) for c in text])
    return wide.unpivot([], text, column_name, count_name)
