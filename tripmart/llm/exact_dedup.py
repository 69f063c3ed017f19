"""Operator 6 [native]: exact duplicates by deterministic block naming.

A text, without white space, is cut into blocks of a fixed number of bytes.
Equal blocks get the same integer name, different ones different names; names
follow the sort order of (64-bit hash, block). Then adjacent names are paired and
every distinct pair is named again, until each document has one name. Two
documents have the same (round, name) exactly if their texts are equal.

The block contents are shuffled once, distinct ones combined before: that shows
whether any hash stands for two different blocks. As long as none does, the
hash alone orders and finds the names; if one does, contents join the sort and
the lookup. Nothing rests on a hash being free of collisions.

Defined results: null counts as empty; all texts that are empty without white
space are equal; repeated rows (also of the same ``doc_id``) are documents of
their own, one of which stays; a null ``doc_id`` ranks last; an empty table gives
an empty result; other columns are left out of the decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.llm.tables import named, place, positional, whole_text
from tripmart.session import materialize

#: Bytes of a block.
BLOCK_BYTES = 16384

#: White space that does not count: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def _named(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys with integer names in sort order, written once."""
    return materialize(keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def _names(docs_blocks: DataFrame, text_blocks: DataFrame) -> DataFrame:
    """First round: rows of ``docs_blocks`` with the name of their block."""
    distinct = text_blocks.select("_h", "_block").distinct()
    keys = materialize(distinct.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")), "hashes")
    by = ["_h"] if keys.where("_n > 1").isEmpty() else ["_h", "_block"]
    names = _named(keys.select("_h") if len(by) == 1 else distinct, by)
    if len(by) > 1:
        docs_blocks = text_blocks
    return docs_blocks.join(names, by).select("_rid", "_i", "_blocks", "name")


def identities(rows: DataFrame, block_bytes: int = BLOCK_BYTES, hashed=F.xxhash64) -> DataFrame:
    """``_rid, _round, _name`` for rows with ``_rid`` and binary ``_norm``."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_norm") / block_bytes)).cast("int")
    cut = rows.withColumn("_blocks", count).select(
        "_rid", "_norm", "_blocks", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_i")
    )
    block = F.substring(F.col("_norm"), F.col("_i") * block_bytes + 1, F.lit(block_bytes))
    cut = cut.select("_rid", "_i", "_blocks", block.alias("_block"))
    cut = cut.withColumn("_h", hashed("_block"))
    level = materialize(_names(cut.drop("_block"), cut), "level")
    done, depth = [], 0
    while True:
        done.append(level.where("_blocks = 1").select("_rid", F.lit(depth).alias("_round"), F.col("name").alias("_name")))
        level = level.where("_blocks > 1")
        if level.isEmpty():
            break
        depth += 1
        odd = F.col("_i") % 2 == 1
        pairs = level.groupBy("_rid", "_blocks", F.floor(F.col("_i") / 2).cast("int").alias("_j")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("_a"),
            F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("_b"),
        )
        names = _named(pairs.select("_a", "_b").distinct(), ["_a", "_b"])
        level = materialize(
            pairs.join(names, ["_a", "_b"]).select(
                "_rid", F.col("_j").alias("_i"), F.ceil(F.col("_blocks") / 2).cast("int").alias("_blocks"), "name"
            ),
            "level",
        )
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _decided(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Decision columns per row of ``rows`` (``_rid, _id, _points``)."""
    rows = rows.join(ids, "_rid")
    best: Column = F.min(F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id").alias("id"), F.col("_rid").alias("rid")))
    groups = rows.groupBy("_round", "_name").agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["_round", "_name"]).withColumn("keep_id", F.col("_best.id")).withColumn(
        "kept", F.col("_best.rid") == F.col("_rid")
    )


def _with_norm(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("_norm", F.translate(whole_text(text_col), BLANKS, "").cast("binary"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                 hashed=F.xxhash64) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``."""
    # numbered once and written: every later use of a row's number reads the file
    numbered = materialize(
        docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")),
        "rows",
    )
    rows = _with_norm(numbered, "_text")
    ids = identities(rows.select("_rid", "_norm"), block_bytes, hashed)
    meta = rows.select("_rid", "_id", F.char_length("_text").alias("_points"), F.sha2("_norm", 256).alias("text_sha256"))
    return _decided(meta, ids).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns, whatever their
    names, with their values."""
    numbered = materialize(positional(docs).withColumn("_rid", F.monotonically_increasing_id()), "rows")
    rows = numbered.select("_rid", F.col(place(docs, id_col)).alias("_id"), whole_text(place(docs, text_col)).alias("_text"))
    ids = identities(_with_norm(rows, "_text").select("_rid", "_norm"))
    meta = rows.select("_rid", "_id", F.char_length("_text").alias("_points"))
    kept = _decided(meta, ids).where("kept").select("_rid")
    return named(numbered.join(kept, "_rid", "left_semi"), docs)


#: The contract of the registered query in SQL.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
