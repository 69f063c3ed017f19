"""Projection helpers: rename, move, apply-to-many, relabel, casts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns (old -> new); names not present are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def move_after(df: DataFrame, name: str, after: str) -> DataFrame:
    """Reposition column ``name`` right after ``after`` (metadata only)."""
    cols = [c for c in df.columns if c != name]
    i = cols.index(after)
    return df.select(*cols[: i + 1], name, *cols[i + 1 :])


def replace_column(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add-update-drop-rename in one step: the new value takes the old
    name and keeps its position."""
    return df.withColumn(name, expr)


TypeSelector = Callable[[T.DataType], bool]


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def across(
    df: DataFrame,
    columns: Iterable[str] | TypeSelector,
    fn: Callable[[Column], Column],
) -> DataFrame:
    """Apply ``fn`` to many columns at once, chosen by name or by a predicate
    on the data type; a single projection, names and order kept."""
    if callable(columns):
        names = [f.name for f in df.schema.fields if columns(f.dataType)]
    else:
        names = list(columns)
    if not names:
        return df
    return df.withColumns({n: fn(F.col(n)) for n in names})


def relabel(c, mapping: Mapping[str, str]) -> Column:
    """Map values through a lookup; values not in the lookup stay as they are."""
    c = as_col(c)
    if not mapping:
        return c
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(lookup[c], c)
