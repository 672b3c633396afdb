"""The corpus operators as queries over the given tables, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, doubling, hard_negatives, langid, licenses, lsh_forest, merkle, mixing, oracle, piece_table, pivot_index, secret_scan, sharding, suffix_levels


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.spelled("base"), 256).alias("base_sha256"), secret_scan.spelled("spans").alias("spans"))


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.edited_fingerprints(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits")


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs", "oversized")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_texts")


def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_levels.deduplicate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.deduplicate(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "declared", "language", F.round("posterior", 6).alias("posterior"), "accepted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hard_negatives.mine(_table(spark, sf_dir, "embeddings"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_table.digests(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.search(_table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = langid.page_evidence(_table(spark, sf_dir, "pages"))
    out = langid.identify(rows, id_col="page_id", declared_col="declared", host_col="host", suffix_col="suffix")
    return out.select(F.col("doc_id").alias("page_id"), "declared", "language", F.round("posterior", 6).alias("posterior"), "accepted")


def queries() -> dict:
    named = (op1_source_mix, op2_decontamination, op3_license_scan, op4_secret_scan, op5_merkle_fingerprints, op6_extendible_shards, op7_jaccard_join, op8_suffix_levels, op9_substring_doubling, op10_language_id, op11_hard_negatives, op12_fill_in_middle, op13_top_k_search, page_language)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
