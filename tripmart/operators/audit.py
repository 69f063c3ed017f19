"""Counts of what a step changes, as metrics of the plan itself.

``metrics`` are plain aggregate expressions by ``(step, column)``. The same ones either
ride along with a write (``observed``: no extra job, no join) or make a report of
their own (``report``: one global aggregate)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.schema import RAW_SCHEMA, TEXT_BOUNDS

Metrics = Mapping[tuple[str, str], Column]


def changed(before: Column, after: Column, among: Column | None = None) -> Column:
    """Rows (``among`` some) whose value is another one afterwards."""
    differs = ~before.eqNullSafe(after)
    return F.count_if(differs if among is None else among & differs)


def load_metrics(df: DataFrame, schema: T.StructType = RAW_SCHEMA, bounds: Mapping[str, int] = TEXT_BOUNDS) -> Metrics:
    """What the typed table does to ``df``: texts cut to their declared width, numbers
    clipped to their decimal."""
    out: dict[tuple[str, str], Column] = {}
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        if f.name in bounds:
            out["cut", f.name] = F.count_if(F.char_length(f.name) > bounds[f.name])
        elif isinstance(f.dataType, T.DecimalType):
            top = 10 ** (f.dataType.precision - f.dataType.scale)
            out["clipped", f.name] = F.count_if(F.abs(F.col(f.name).cast("double")) >= top)
    return out


def _name(key: tuple[str, str]) -> str:
    return "/".join(key)


def observed(df: DataFrame, metrics: Metrics, into: Observation) -> DataFrame:
    """``df`` whose next action also fills ``into`` (``step/column`` -> count)."""
    return df.observe(into, *[c.alias(_name(k)) for k, c in metrics.items()])


def report(df: DataFrame, metrics: Metrics, count_name: str = "changed") -> DataFrame:
    """``step, column_name, <count_name>``, one row per metric."""
    wide = df.agg(*[c.alias(_name(k)) for k, c in metrics.items()])
    rows = [F.struct(F.lit(k[0]).alias("step"), F.lit(k[1]).alias("column_name"), F.col(f"`{_name(k)}`").alias(count_name)) for k in metrics]
    return wide.select(F.inline(F.array(*rows)))
