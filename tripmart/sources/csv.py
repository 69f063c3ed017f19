"""CSV sources and sinks for the monthly trip files.

The default read is one distributed scan of a whole directory with an
explicit schema (positional, header skipped, splittable: ``multiLine`` off),
replacing one bulk load per monthly file. Inferred per-file reads and the
by-name union exist for files whose columns drift.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.schema import RAW_SCHEMA
from tripmart.session import materialize

CORRUPT = "_corrupt_record"


#: How batch and stream read a file.
CSV_OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "false"}


def _reader(spark: SparkSession, header: bool = True):
    return (
        spark.read.option("header", header)
        .options(**CSV_OPTIONS)
    )


def lossless(schema: T.StructType) -> T.StructType:
    """``schema`` with its decimals read as doubles: a value that a decimal
    can't hold would be read as NULL, and cleaning would delete its row."""
    return T.StructType([T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, T.DecimalType) else f.dataType) for f in schema.fields])


def clip_decimal(c: Column, kind: T.DecimalType) -> Column:
    """A number as ``kind``: rounded to its scale, out of range the nearest bound."""
    top = F.lit("9" * (kind.precision - kind.scale) + "." + "9" * kind.scale).cast(kind)
    bound = float(10 ** (kind.precision - kind.scale))
    c = c.try_cast("double")
    return F.when(F.isnan(c), None).when(c >= bound, top).when(c <= -bound, -top).otherwise(F.coalesce(c.try_cast(kind), F.when(c > 0, top).when(c < 0, -top))).cast(kind)


def clipped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Decimals of ``schema`` from the doubles of ``lossless``, clipped."""
    own = {f.name: clip_decimal(F.col(f.name), f.dataType) for f in schema.fields if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(own) if own else df


def read_trips(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RAW_SCHEMA, glob: str = "*.csv") -> DataFrame:
    """All files under ``path`` matching ``glob`` in one scan, typed by
    ``schema`` by position (the header row is skipped, not matched). A number
    beyond a decimal's range is clipped, not lost; pass ``RAW_DOUBLES`` to keep
    coordinates as they are. CRLF and
    LF line ends are both accepted. Partition folders (``period=...``) add
    their column."""
    r = _reader(spark).schema(lossless(schema)).option("enforceSchema", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return clipped(r.csv(path), schema)


def field_count(line: Column) -> Column:
    """Fields of a CSV line: separators outside quotes, plus one."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1


def widest(spark: SparkSession, path: str | Sequence[str]) -> int:
    """Fields of the widest line (0: no lines): one global aggregate over the text."""
    return spark.read.text(path).agg(F.coalesce(F.max(field_count(F.col("value"))), F.lit(0))).first()[0]


def read_ragged(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType = RAW_SCHEMA,
    header: bool = False,
    keep_corrupt: bool = False,
    widen: bool = True,
) -> DataFrame:
    """Rows with too few fields are padded with NULL. With ``widen``, lines with
    more fields than ``schema`` add text columns (``V14`` for a fourteenth field),
    NULL elsewhere; without, extra fields are dropped. A number beyond a decimal's
    range is clipped. With ``keep_corrupt`` a line whose number of fields differs
    is kept in ``_corrupt_record``."""
    if widen:
        more = range(len(schema.fields) + 1, widest(spark, path) + 1)
        schema = T.StructType(schema.fields + [T.StructField(f"V{i}", T.StringType()) for i in more])
    if keep_corrupt:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    r = _reader(spark, header).schema(lossless(schema)).option("enforceSchema", True)
    if keep_corrupt:
        r = r.option("columnNameOfCorruptRecord", CORRUPT)
    return clipped(r.csv(path), schema)


def conform(df: DataFrame, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Select ``schema``'s columns by name with its types (absent -> NULL;
    values that do not convert -> NULL), keeping extra columns after them."""
    present = set(df.columns)
    cols: list[Column] = []
    for f in schema.fields:
        if f.name in present:
            c = F.col(f"`{f.name}`")
            kept = clip_decimal(c, f.dataType) if isinstance(f.dataType, T.DecimalType) else c.try_cast(f.dataType)
            cols.append(kept.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [F.col(f"`{c}`") for c in df.columns if c not in {f.name for f in schema.fields}]
    return df.select(*cols, *extra)


#: Larger than any file: a file is one split.
WHOLE_FILE = 1 << 43

#: Files whose first lines one job reads.
FILES_A_JOB = 64


def first_lines(spark: SparkSession, path: str | Sequence[str], glob: str = "*.csv") -> list[DataFrame]:
    """``file, header``: the first line of each file that is not blank, as the CSV
    reader finds it (a file without one has no rows). Every file is a task of its own
    that stops at that line, so what is read is one buffer per file, not the files.
    The setting that keeps a file in one split is that of a session of its own."""
    own = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(key, str(WHOLE_FILE))
    files = [unquote(f) for f in own.read.options(**({"pathGlobFilter": glob} if glob else {})).text(path).inputFiles()]

    def first(file: str) -> DataFrame:
        line = own.read.text(file).where(F.col("value").rlike(r"[^\x00-\x20]")).limit(1)
        return line.select(F.lit(file).alias("file"), F.col("value").alias("header"))

    return [reduce(DataFrame.unionAll, map(first, files[i : i + FILES_A_JOB])) for i in range(0, len(files), FILES_A_JOB)]


def header_groups(spark: SparkSession, path: str | Sequence[str], glob: str = "*.csv") -> list[tuple[list[str], list[str]]]:
    """``(column names, files)`` for every distinct header line under ``path``. The
    driver gets one row per file, as a scan's own file listing does."""
    groups: dict[str, list[str]] = {}
    for some in first_lines(spark, path, glob):
        for r in some.collect():
            groups.setdefault(r.header, []).append(r.file)
    return [(next(csv.reader([h.lstrip("\ufeff").rstrip("\r")])), sorted(files)) for h, files in sorted(groups.items())]


def _group_reader(spark: SparkSession, path: str | Sequence[str], files: Sequence[str]):
    """Reader for some files of ``path``; its partition folders stay columns."""
    r = _reader(spark)
    inside = isinstance(path, str) and not any(f.endswith(path) for f in files)
    return r.option("basePath", path) if inside else r


def _by_header(spark: SparkSession, path, glob: str, typed, file: bool = False) -> list[DataFrame]:
    """One scan per distinct header; ``typed(name)`` gives a column's type."""
    frames = []
    for names, files in header_groups(spark, path, glob):
        own = T.StructType([T.StructField(n, typed(n)) for n in names])
        rows = _group_reader(spark, path, files).schema(lossless(own)).option("enforceSchema", True).csv(files)
        if file:
            rows = rows.select("*", F.col("_metadata.file_path").alias("_file"))
        frames.append(clipped(rows, own))
    return frames


def read_by_name(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RAW_SCHEMA, glob: str = "*.csv") -> DataFrame:
    """Read files whose headers name the columns. Files of one folder may differ
    in order and subset: each distinct header is one scan with its own column
    order, and the scans are appended by name (absent columns NULL). ``schema``
    gives the types of known names (a number beyond a decimal's range is
    clipped); other columns are text."""
    known = {f.name: f.dataType for f in schema.fields}
    frames = _by_header(spark, path, glob, lambda n: known.get(n, T.StringType()))
    return union_by_name(frames) if frames else spark.createDataFrame([], schema)


#: Types from narrow to wide; a column of a file has the narrowest one that holds all
#: its values, columns of several files the widest of theirs.
LATTICE = ["void", "int", "bigint", "double", "string"]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def lattice_rank(c: Column) -> Column:
    """Place in ``LATTICE`` of a value's own narrowest type."""
    c = c.cast("string")  # partition folders come as numbers
    whole = c.rlike(r"^[+-]?[0-9]+$")
    return (
        F.when(c.isNull() | (c == ""), 0)
        .when(whole & c.try_cast("int").isNotNull(), 1)
        .when(whole & c.try_cast("bigint").isNotNull(), 2)
        .when(c.rlike(NUMBER), 3)
        .otherwise(4)
    )


def file_types(rows: DataFrame) -> DataFrame:
    """Per ``_file``, the place in ``LATTICE`` of every other column: one partially
    aggregated pass over all files."""
    return rows.groupBy("_file").agg(*[F.max(lattice_rank(F.col(f"`{c}`"))).alias(c) for c in rows.columns if c != "_file"])


def inferred_text(rows: DataFrame) -> DataFrame:
    """Text rows (with ``_file``) as their files' types write them: a column of whole
    numbers loses leading zeros, one of numbers is written as doubles, text stays."""
    names = [c for c in rows.columns if c != "_file"]
    types = materialize(file_types(rows).withColumnsRenamed({c: f"_type {c}" for c in names}), "file-types")

    def written(c: str) -> Column:
        own, kind = F.col(f"`{c}`"), F.col(f"`_type {c}`")
        return F.when(kind <= 2, own.try_cast("bigint").cast("string")).when(kind == 3, own.try_cast("double").cast("string")).otherwise(own).alias(c)

    return rows.join(types, "_file").select("_file", *[written(c) for c in names])


def _inferred(spark: SparkSession, path, glob: str) -> DataFrame | None:
    frames = _by_header(spark, path, glob, lambda _: T.StringType(), file=True)
    return inferred_text(union_by_name(frames)) if frames else None


def read_inferred(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RAW_SCHEMA, glob: str = "*.csv") -> DataFrame:
    """Types inferred per file over all its rows, widened by appending the files by
    name, then conformed to ``schema``. ``inference_report`` counts what does not
    convert. The explicit schema of ``read_trips`` is the default path; this is for
    files whose types are not known."""
    rows = _inferred(spark, path, glob)
    return conform(rows.drop("_file"), schema) if rows is not None else spark.createDataFrame([], schema)


def inference_report(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RAW_SCHEMA, glob: str = "*.csv") -> DataFrame:
    """``column_name, inferred, lost``: the type of each column of ``schema`` over all files
    and how many of its values have no value of the schema's type (NULL after
    ``read_inferred``)."""
    rows = _inferred(spark, path, glob)
    if rows is None:
        return spark.createDataFrame([], "column_name string, inferred string, lost long")
    own = [f for f in schema.fields if f.name in rows.columns]
    names = F.array(*map(F.lit, LATTICE))
    wide = rows.agg(*[
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.element_at(names, F.max(lattice_rank(F.col(f.name))) + 1).alias("inferred"),
            F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast("double" if isinstance(f.dataType, T.DecimalType) else f.dataType).isNull()).alias("lost"),
        ).alias(f.name) for f in own
    ])
    return wide.select(F.inline(F.array(*[F.col(f.name) for f in own])))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Append frames by column name; a column absent from a frame is NULL
    there. A plan-level union: no data moves."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str, line_sep: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """CSV with a header and no row index. Spark's writer trims text by
    default; both trims are turned off so values round-trip unchanged."""
    w = (
        df.write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("quote", '"')
        .option("escape", '"')
    )
    if line_sep:
        w = w.option("lineSep", line_sep)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def period_from_file(file_path: Column | None = None) -> Column:
    """``YYYYMM`` from the file name (``Bike_Data_202201.csv``) or, failing
    that, from a ``period=YYYYMM`` folder; NULL when neither is present."""
    p = file_path if file_path is not None else F.col("_metadata.file_path")
    from_name = F.regexp_extract(p, r"_(\d{6})\.csv$", 1)
    from_dir = F.regexp_extract(p, r"period=(\d{6})/", 1)
    return F.coalesce(F.nullif(from_name, F.lit("")), F.nullif(from_dir, F.lit("")))
