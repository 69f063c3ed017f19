"""Operator 7: SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Fingerprints that differ in at most
three bits differ in at most one bit in one of the halves. So every distinct
fingerprint is indexed, per half, under the exact half and under the half with
each single bit as a wildcard; where a wildcard entry has bit 0 it is equality-
joined with entries of bit 1, so a pair meets once per half that brings it
together; then the distance is verified. Links give components.

Equal fingerprints are one class before the join, so copies never make pairs.
The index has 66 entries a fingerprint, written by built-in functions.

Defined results: null and empty texts (and those of white space alone) have
fingerprint zero, linked like any other; fewer words than a shingle: the whole
sequence is the shingle; repeated rows are rows; ``component_id`` ignores null ids
unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.tables import components, named, place, positional, whole_text, without
from tripmart.llm.words import chunks
from tripmart.session import materialize

SEED = 42
HALF = 32

#: Shingle hashes whose bits are counted at a time.
COUNT_AT_A_TIME = 65536


def fingerprint(text: str, words: int) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    import xxhash

    # bytes.lower and bytes.split know only A-Z and [\x20\x09-\x0D]
    own = text.encode().lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(words, len(own))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_AT_A_TIME):
        part = np.array(hashes[at : at + COUNT_AT_A_TIME], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(hashes))
    return sum(1 << int(b) for b in bits)


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with ``_fp`` (the fingerprint's 64 bits as a long; a column of that name is
    replaced); a narrow map over chunks of about a megabyte."""
    rows = without(docs, "_fp")
    schema = rows.withColumn("_fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in chunks(batch.column(batch.schema.get_field_index(text_col))):
                own = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.view(np.int64))], names=[*part.schema.names, "_fp"])

    return rows.mapInArrow(run, schema)


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints at ``distance`` bits or fewer
    (at most three: one of two halves then differs by at most one bit)."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves serve distances 0 to 3")
    low = (1 << HALF) - 1
    index = distinct.select("_fp", F.explode(F.sequence(F.lit(0), F.lit(2 * HALF + 1))).alias("_e"))
    index = index.withColumn("_bit", F.expr("_e div 2").cast("int"))
    half = F.when(F.col("_e") % 2 == 0, F.col("_fp").bitwiseAND(F.lit(low))).otherwise(F.shiftrightunsigned("_fp", HALF))
    index = index.withColumn("_half", half)
    one = F.expr("CASE WHEN _bit < 32 THEN shiftleft(1L, _bit) ELSE 0L END")
    is_one = F.col("_half").bitwiseAND(one) != 0
    masked = F.when(is_one, F.col("_half").bitwiseXOR(one)).otherwise(F.col("_half"))
    index = index.select("_fp", (F.shiftleft(F.col("_e").cast("long"), HALF) + masked).alias("_key"), (F.col("_bit") == 32).alias("_exact"), is_one.alias("_one"))
    a = index.where("_exact OR NOT _one").select("_key", "_exact", F.col("_fp").alias("a"))
    b = index.where("_exact OR _one").select("_key", F.col("_fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return a.join(b, "_key").where(near & (~F.col("_exact") | (F.col("a") < F.col("b")))).select("a", "b")


def classes(rows: DataFrame, id_col: str, distance: int = 3) -> DataFrame:
    """``_fp, component_id`` for every distinct fingerprint of ``rows``."""
    distinct = materialize(rows.groupBy("_fp").agg(F.min(id_col).alias("_low")), "fingerprints")
    roots = components(links(distinct, distance), "a", "b")
    rooted = distinct.join(roots, distinct["_fp"] == roots["node"], "left").select(
        "_fp", "_low", F.coalesce("root", "_fp").alias("_root")
    )
    least = rooted.groupBy("_root").agg(F.min("_low").alias("component_id"))
    return rooted.join(least, "_root").select("_fp", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: ``id_col, fingerprint`` (16 hex digits),
    ``component_id`` (smallest id reachable by links)."""
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    rows = materialize(fingerprints(rows, "_text", words).select("_id", "_fp"), "rows")
    found = rows.join(classes(rows, "_id", distance), "_fp")
    return found.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (of equal ids the
    first read); all columns, whatever their names, with their values."""
    rows = fingerprints(positional(docs), place(docs, text_col), words).withColumn("_rid", F.monotonically_increasing_id())
    rows = materialize(rows, "rows")
    ids = rows.select("_rid", F.col(place(docs, id_col)).alias("_id"), "_fp")
    # a component's lowest row: first per fingerprint, then over its fingerprints
    low = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_rid").alias("rid")))
    per_print = materialize(ids.groupBy("_fp").agg(low.alias("_low")), "fingerprints")
    roots = components(links(per_print.select("_fp"), distance), "a", "b")
    rooted = per_print.join(roots, per_print["_fp"] == roots["node"], "left").select("_low", F.coalesce("root", "_fp").alias("_root"))
    kept = rooted.groupBy("_root").agg(F.min("_low").alias("_low")).select(F.col("_low.rid").alias("_rid"))
    return named(rows.join(kept, "_rid", "left_semi"), docs)
