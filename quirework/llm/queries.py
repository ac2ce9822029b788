"""Registered queries of this subpackage, over the whole ``documents`` table, and their SQL."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quirework.llm import alignment, decontaminate, exact_dedup, hard_negatives, language_id, licenses, line_dedup, mixing, near_dedup, packing, passage_dedup, quality, suffix_dedup

TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup_substrings(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(documents(spark, sf_dir))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op5_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("detections")


def op6_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(documents(spark, sf_dir))


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), shingle=2)


def op9_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passage_dedup.dedup_passages(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op10_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op11_l2ap_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", label), lambda i: i % 100 == 0)


def op12_exponential_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op13_incidence_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.align_tokenizers(documents(spark, sf_dir), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bucket_pointers": op1_bucket_pointers,
    "op2_context_trees": op2_context_trees,
    "op3_rule_ensemble": op3_rule_ensemble,
    "op4_sum_of_squares": op4_sum_of_squares,
    "op5_signature_rules": op5_signature_rules,
    "op6_block_max_wand": op6_block_max_wand,
    "op7_line_windows": op7_line_windows,
    "op8_circulant_minhash": op8_circulant_minhash,
    "op9_token_windows": op9_token_windows,
    "op10_tree_merge": op10_tree_merge,
    "op11_l2ap_negatives": op11_l2ap_negatives,
    "op12_exponential_keys": op12_exponential_keys,
    "op13_incidence_products": op13_incidence_products,
}
ORACLES: dict[str, str] = {
    "op7_line_windows": line_dedup.QUERY_SQL,
    "op10_tree_merge": exact_dedup.QUERY_SQL,
    "op11_l2ap_negatives": hard_negatives.QUERY_SQL,
    "op12_exponential_keys": mixing.QUERY_SQL,
}
