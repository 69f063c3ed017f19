"""Grouped summaries: labelled ROLLUP / CUBE, conditional pivots, wide
pivots, gap-filled histograms and group-relative windows.

Every aggregate here is a hash aggregate with a partial (map-side) step, so
only one partial row per group and task crosses the shuffle: a hot group
(one user type holding most rides) is combined before it is exchanged.
Windows run on aggregated rows only (a handful per partition key).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.functions.columns import as_col
from tripmart.session import materialize


@dataclass(frozen=True)
class Measure:
    """A decomposable aggregate: computed per detail group first, then
    re-aggregated for the subtotal rows.

    ``kind``: ``rows`` (COUNT(*)), ``count`` (non-NULL count of ``expr``),
    ``sum``, ``avg``, ``min``, ``max``; over pre-aggregated input,
    ``wsum`` (a count carried as a weight column: sum, 0 when empty) and
    ``ratio`` (``sum(expr) / sum(den)``, an average carried as sum and
    count). ``digits`` rounds the final value."""

    name: str
    kind: str
    expr: Column | None = None
    digits: int | None = None
    den: Column | None = None  # denominator of a ``ratio``


def count_rows(name: str) -> Measure:
    return Measure(name, "rows")


def count_of(expr, name: str) -> Measure:
    return Measure(name, "count", as_col(expr))


def mean(expr, name: str, digits: int | None = None) -> Measure:
    return Measure(name, "avg", as_col(expr), digits)


def total(expr, name: str) -> Measure:
    return Measure(name, "sum", as_col(expr))


def minimum(expr, name: str) -> Measure:
    return Measure(name, "min", as_col(expr))


def maximum(expr, name: str) -> Measure:
    return Measure(name, "max", as_col(expr))


@dataclass(frozen=True)
class Weights:
    """Column names of a pre-aggregated trip summary (``plans.summary``):
    rows per summary row, and the count / sum / min / max of ride length."""

    rows: str = "_n"
    n_len: str = "_n_len"
    sum_len: str = "_sum_len"
    min_len: str = "_min_len"
    max_len: str = "_max_len"


def rows_measure(name: str, w: Weights | None = None, when: Column | None = None) -> Measure:
    """COUNT(*) (optionally of rows matching ``when``), on trips or on a summary."""
    if w is None:
        return count_rows(name) if when is None else Measure(name, "count", F.when(when, F.lit(1)))
    weight = F.col(w.rows)
    return Measure(name, "wsum", weight if when is None else F.when(when, weight))


def len_count_measure(name: str, length: str, w: Weights | None = None) -> Measure:
    """Non-NULL count of the ride length, on trips or on a summary."""
    return count_of(length, name) if w is None else Measure(name, "wsum", F.col(w.n_len))


def len_mean_measure(name: str, length: str, w: Weights | None = None, when: Column | None = None, digits: int | None = None) -> Measure:
    """Mean ride length (optionally over rows matching ``when``)."""
    if w is None:
        e = F.col(length) if when is None else F.when(when, F.col(length))
        return Measure(name, "avg", e, digits)
    num, den = F.col(w.sum_len), F.col(w.n_len)
    if when is not None:
        num, den = F.when(when, num), F.when(when, den)
    return Measure(name, "ratio", num, digits, den)


def _detail(m: Measure, i: int) -> list[Column]:
    e = m.expr
    if m.kind == "rows":
        return [F.count(F.lit(1)).alias(f"_c{i}")]
    if m.kind == "count":
        return [F.count(e).alias(f"_c{i}")]
    if m.kind == "sum":
        return [F.sum(e).alias(f"_s{i}")]
    if m.kind == "avg":
        return [F.sum(e).alias(f"_s{i}"), F.count(e).alias(f"_c{i}")]
    if m.kind in ("min", "max"):
        return [getattr(F, m.kind)(e).alias(f"_v{i}")]
    if m.kind == "wsum":
        return [F.sum(e).alias(f"_c{i}")]
    if m.kind == "ratio":
        return [F.sum(e).alias(f"_s{i}"), F.sum(m.den).alias(f"_c{i}")]
    raise ValueError(f"unknown measure kind {m.kind!r}")


def _combine(m: Measure, i: int) -> Column:
    if m.kind in ("rows", "count"):
        v = F.sum(f"_c{i}")
    elif m.kind == "sum":
        v = F.sum(f"_s{i}")
    elif m.kind in ("avg", "ratio"):
        v = F.try_divide(F.sum(f"_s{i}").cast("double"), F.sum(f"_c{i}"))
    elif m.kind == "wsum":
        v = F.coalesce(F.sum(f"_c{i}"), F.lit(0).cast("bigint"))
    else:
        v = getattr(F, m.kind)(f"_v{i}")
    if m.digits is not None:
        v = F.round(v, m.digits)
    return v.alias(m.name)


def _labelled(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Measure],
    totals: Mapping[str, str],
    names: Mapping[str, str] | None,
    how: str,
) -> DataFrame:
    """Two phases. (1) ``groupBy(keys)`` on the input: a plain hash
    aggregate, partial per task, so one row per group and task crosses the
    shuffle and every input row is aggregated once (not once per grouping
    set, as ``Expand`` would). (2) ROLLUP / CUBE over those detail groups -
    a few rows per key combination - re-aggregating the partial measures."""
    names = dict(names or {})
    detail = df.groupBy(*keys).agg(*[c for i, m in enumerate(measures) for c in _detail(m, i)])
    grouped = detail.cube(*keys) if how == "cube" else detail.rollup(*keys)
    flags = [F.grouping(k).alias(f"_g{i}") for i, k in enumerate(keys)]
    out = grouped.agg(*[_combine(m, i) for i, m in enumerate(measures)], *flags)
    labelled = [
        F.when(F.col(f"_g{i}") == 1, F.lit(totals[k])).otherwise(F.col(k).cast("string")).alias(names.get(k, k))
        for i, k in enumerate(keys)
    ]
    return out.select(*labelled, *[m.name for m in measures])


def rollup_labeled(df, keys, measures, totals, names=None) -> DataFrame:
    """``GROUP BY keys WITH ROLLUP`` with each super-aggregate key replaced by
    its total label through ``grouping()`` - a real NULL key stays a separate
    group (``COALESCE`` would merge it with the total)."""
    return _labelled(df, keys, measures, totals, names, "rollup")


def cube_labeled(df, keys, measures, totals, names=None) -> DataFrame:
    """All combinations of detail and total for every key, labelled."""
    return _labelled(df, keys, measures, totals, names, "cube")


def rollup_coalesced(df, key: str, measures, total: str, name: str | None = None) -> DataFrame:
    """The literal ``COALESCE(key, total)`` form of a one-key rollup label:
    a NULL key and the grand total both come out as ``total``."""
    detail = df.groupBy(key).agg(*[c for i, m in enumerate(measures) for c in _detail(m, i)])
    out = detail.rollup(key).agg(*[_combine(m, i) for i, m in enumerate(measures)])
    return out.select(F.coalesce(F.col(key).cast("string"), F.lit(total)).alias(name or key), *[m.name for m in measures])


def conditional_measures(
    pivot: Column | str,
    values: Sequence[str],
    kind: str,
    value: Column | None,
    name: Callable[[str], str],
) -> list[Measure]:
    """One measure per pivot value over ``CASE WHEN pivot = v THEN value END``
    (a hand pivot inside the same aggregate - no pass to find the values)."""
    pivot = as_col(pivot)
    v = F.lit(1) if value is None else value
    return [Measure(name(x), kind, F.when(pivot == F.lit(x), v)) for x in values]


def pivot_wide(
    long_df: DataFrame,
    keys: Sequence[str],
    pivot: str,
    values: Sequence[str],
    value_col: str,
    prefix: str,
) -> DataFrame:
    """Long -> wide with an explicit value list and a name prefix; a missing
    cell is NULL. Input must have one row per (keys, pivot)."""
    wide = long_df.groupBy(*keys).pivot(pivot, list(values)).agg(F.first(value_col))
    return wide.select(*keys, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def histogram(
    df: DataFrame,
    col: str,
    width: float = 1.0,
    show_from: float | None = None,
    show_to: float | None = None,
    bin_name: str = "bin",
    count_name: str = "n",
) -> DataFrame:
    """Fixed-width histogram. Bin ``b`` is centred on ``b * width`` and closed
    on the right: ``((b - 0.5) * width, (b + 0.5) * width]``. Every bin between
    the first and last non-empty bin is present (count 0 when empty). The
    optional display range keeps bins whose centre lies in it, without
    dropping data from any bin.

    One scan: the per-bin counts (a partial aggregate, at most one row per
    bin) are written to the shared checkpoint folder; the first and last bin (two
    numbers) come from that table, and the bins between them, within the display
    range, are a distributed range that the counts join."""
    x = F.col(col)
    b = F.ceil(x / F.lit(width) - F.lit(0.5)).cast("bigint")
    counts = df.where(x.isNotNull()).groupBy(b.alias(bin_name)).agg(F.count(F.lit(1)).alias(count_name))
    counts = materialize(counts, "histogram")
    lo, hi = counts.agg(F.min(bin_name), F.max(bin_name)).first()
    if lo is None:
        return counts
    if show_from is not None:
        lo = max(lo, int(-(-show_from // width)))  # ceil
    if show_to is not None:
        hi = min(hi, int(show_to // width))
    grid = df.sparkSession.range(lo, max(lo, hi + 1)).select(F.col("id").alias(bin_name))
    return grid.join(counts, bin_name, "left").select(
        bin_name, F.coalesce(F.col(count_name), F.lit(0).cast("bigint")).alias(count_name)
    )


def share_of_group(value: str, partition: Sequence[str], scale: float = 100.0) -> Column:
    """``value / sum(value) over the group * scale`` (ratio to report)."""
    w = Window.partitionBy(*partition)
    return F.col(value) / F.sum(value).over(w) * F.lit(scale)


def running_sum(expr: Column, partition: Sequence[str], order: Sequence[Column]) -> Column:
    """Cumulative sum in ``order`` within each group (ROWS frame: the order
    must be unique within a group for a deterministic result)."""
    w = (
        Window.partitionBy(*partition)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.sum(expr).over(w)


def thousands_label(c, digits: int = 0, suffix: str = " K") -> Column:
    """Count scaled to thousands with a suffix (``12,345`` -> ``12 K``)."""
    return F.concat(F.format_number(as_col(c) * F.lit(1e-3), digits), F.lit(suffix))
