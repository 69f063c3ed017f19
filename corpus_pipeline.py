"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input. All but the last return the columns of
``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.llm import exact_dedup, packing, pii, simhash, toxicity
from tripmart.llm.queries import tokenizer
from tripmart.llm.tables import named, place, positional, table
from tripmart.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents scored 0.5 or more go; columns keep their values, also
    one named like the score."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return named(toxicity.score(positional(docs), model, place(docs, "text")).where("score < 0.5"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of equal texts stays."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near-duplicates stays."""
    return simhash.drop_near(docs, words=3, distance=3)


def remove_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data and disclosing terms are generalised in the
    text; ``n_chars`` follows it."""
    clean = pii.sanitize(docs, everywhere=True, evidence=20, parts=True)
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of all documents in sequences of 2048 ids."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), size=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", remove_private),
    ("packing", pack),
]

#: SQL has no conditional random field; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
