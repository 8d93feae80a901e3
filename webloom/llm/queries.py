"""The registered query of each operator: documents or embeddings whole, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import centroids, extract, lines, mixing, near, neighbours, passages, pieces, quality, secrets, shards, simhash, trie
from webloom.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_of_table(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.group_near(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie_of_rebuilt(table(spark, sf_dir, "conversations"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_passages": op3_passages,
    "op4_nearest": op4_nearest,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_centroids": op11_centroids,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_extraction": op13_extraction,
}
#: Models, sampled draws, fingerprints and positions of matches have no SQL; tests hold those against plain versions.
ORACLES = {
    "op3_passages": passages.ORACLE,
    "op5_line_dedup": lines.ORACLE,
    "op6_near_dedup": near.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_extraction": extract.ORACLE,
}
