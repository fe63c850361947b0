"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.sources.tables import read_table

from . import (alignment, bpe, decontaminate, embed_dedup, language, licenses, line_dedup, near_dup, prefix_trie,
               quality, repeats, secrets, sharding)
from .sql import ORACLE_SQL  # noqa: F401 (read by the entry file)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"),
                                      read_table(spark, sf_dir, "benchmark"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(read_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(read_table(spark, sf_dir, "documents"))


def op5_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"))


def op6_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_links(read_table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.predicted(docs, language.train(docs))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                      tokenizer_path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_bpe_round_trip, op3_repeated_passages, op4_secret_scan,
    op5_vector_sharding, op6_embedding_near_dup, op7_line_dedup, op8_near_duplicates, op9_license_scan, op10_quality,
    op11_language_id, op12_tokenizer_alignment, op13_prefix_trie)}
