"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawise.llm import common, lsh_forest, media_chunks, pareto_mix, pii_crf, prefix_bpe, rule_quality, secret_scan, suffix_dedup, token_files, weak_rules


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files, read the files back."""
    out = common.scratch(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, out)


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base patterns and the CRF's additions."""
    return pii_crf.find_pii(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated passages of 20 words and more."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), depth=20)


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text with the rule ensemble learnt from the labels."""
    docs = documents(spark, sf_dir)
    model = rule_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = rule_quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", rule_quality.held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at a Jaccard similarity of 0.8 over 5-word shingles."""
    return lsh_forest.jaccard_join(documents(spark, sf_dir))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the weights 5, 2, 1 of their sources."""
    mixed = pareto_mix.mix_sizes(documents(spark, sf_dir))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text by prefix tables."""
    return prefix_bpe.bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every whole text."""
    return secret_scan.find_secrets(documents(spark, sf_dir))


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics, the hard base rule and the posterior verdict of every document."""
    judged, _ = weak_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as chunked media, read it back and compute its values."""
    out = common.scratch(spark, "media")
    return media_chunks.read_media(media_chunks.store_media(documents(spark, sf_dir), out), out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_pii_crf": op2_pii_crf,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_rule_quality": op4_rule_quality,
    "op5_lsh_forest": op5_lsh_forest,
    "op6_pareto_mix": op6_pareto_mix,
    "op7_prefix_bpe": op7_prefix_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_weak_rules": op9_weak_rules,
    "op10_media_chunks": op10_media_chunks,
}
ORACLES: dict[str, str] = {}
