"""Registered queries of this subpackage: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.llm import exact_dedup
from tripmart.llm.embeddings import near_vectors
from tripmart.llm.exact_dedup import exact_groups
from tripmart.llm.licences import scan_licences
from tripmart.llm.packing import pack
from tripmart.llm.pieces import encode
from tripmart.llm.pii import find_private
from tripmart.llm.quality import score_quality
from tripmart.llm.runs import find_runs, periodic_tails, run_report
from tripmart.llm.sharding import interleave
from tripmart.llm.simhash import near_groups
from tripmart.llm.tables import table
from tripmart.llm.token_counts import count_tokens
from tripmart.llm.toxicity import score_toxicity
from tripmart.llm.variants import variant_groups, vocabulary, words_of


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"), shards=16)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"), everywhere=True, evidence=20, parts=True)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=3, distance=3)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), size=2048)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), decoded=True)
    return both.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(find_runs(periodic_tails(table(spark, sf_dir, "documents"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = words_of(table(spark, sf_dir, "documents"), drop_every=199)
    return variant_groups(vocabulary(words, least_length=6, least_count=5), least_length=6, ratio=5)


def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).drop("notices")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_licence_scan": op13_licence_scan,
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
}
