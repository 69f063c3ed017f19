"""Range join to the duration bands, the CASE form of the bands, and the
geographic window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.functions.columns import as_col
from tripmart.schema import BAND_OTHER, BANDS


def bands_frame(spark: SparkSession, bands: Sequence[tuple[str, int, int]] = BANDS) -> DataFrame:
    """The inline ``(name, low_limit, high_limit)`` table, built from
    literals on the JVM side (no Python rows to ship)."""
    rows = [
        F.struct(F.lit(n).cast("string").alias("name"), F.lit(lo).cast("int").alias("low_limit"), F.lit(hi).cast("int").alias("high_limit"))
        for n, lo, hi in bands
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def band_join(df: DataFrame, value: str, bands: Sequence[tuple[str, int, int]] = BANDS) -> DataFrame:
    """Inner range join ``value BETWEEN low_limit AND high_limit`` (inclusive);
    values in no band vanish. The bands are a literal list, never a table, so
    their size is known; they are broadcast and the ride side is never shuffled."""
    b = F.broadcast(bands_frame(df.sparkSession, bands))
    return df.join(b, F.col(value).between(b["low_limit"], b["high_limit"]), "inner")


def band_case(c, bands: Sequence[tuple[str, int, int | None]], other: str | None = BAND_OTHER) -> Column:
    """``case_when`` banding: first matching inclusive range wins; a band with
    upper limit ``None`` is open-ended; anything else is ``other`` (NULL
    when ``other`` is None)."""
    c = as_col(c)
    out = None
    for name, lo, hi in bands:
        cond = c >= F.lit(lo) if hi is None else (c >= F.lit(lo)) & (c <= F.lit(hi))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(other).cast("string"))


def within_bbox(lat, lng, box: Mapping[str, float]) -> Column:
    """Point inside the box ``{top, right, bottom, left}`` (edges included)."""
    return as_col(lat).between(F.lit(box["bottom"]), F.lit(box["top"])) & as_col(lng).between(
        F.lit(box["left"]), F.lit(box["right"])
    )


def route_within_bbox(box: Mapping[str, float]) -> Column:
    """Both endpoints of a route inside the box."""
    return within_bbox("start_lat", "start_lng", box) & within_bbox("end_lat", "end_lng", box)
