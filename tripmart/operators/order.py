"""Ordering by list position, by factor level, and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.functions.columns import as_col


def field_position(c, levels: Sequence[str]) -> Column:
    """1-based position of the value in ``levels``; 0 when absent or NULL
    (the ``FIELD()`` rule, so unknown values sort first)."""
    arr = F.array(*[F.lit(x) for x in levels])
    return F.coalesce(F.array_position(arr, as_col(c)), F.lit(0).cast("bigint"))


def level_rank(c, levels: Sequence[str]) -> Column:
    """1-based factor level; NULL when not a level (so it sorts last)."""
    pos = field_position(c, levels)
    return F.when(pos > 0, pos)


def order_by_field(df: DataFrame, *specs: tuple[str, Sequence[str]]) -> DataFrame:
    """``ORDER BY FIELD(a, ...), FIELD(b, ...)``."""
    return df.orderBy(*[field_position(c, lv) for c, lv in specs])


def order_by_levels(df: DataFrame, *specs: tuple[str, Sequence[str]]) -> DataFrame:
    """``arrange(factor(a, levels = ...))``: non-levels last."""
    return df.orderBy(*[level_rank(c, lv).asc_nulls_last() for c, lv in specs])


def top_k(df: DataFrame, k: int, by: Sequence[Column], tie_break: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows of a total order (``ORDER BY ... LIMIT k``), planned
    as a per-partition top-k plus one merge of ``k`` rows per partition.
    ``tie_break`` columns make the cut deterministic."""
    order = list(by) + [F.col(t).asc_nulls_first() for t in tie_break]
    return df.orderBy(*order).limit(k)
