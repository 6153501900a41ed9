"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from explainkit.llm import containment, html_blocks, merge_counts, oracles, passages, pieces, quality, simhash, sstable, suffix_tree, toxicity

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(read(spark, sf_dir, "documents"), vocabulary(PIECES))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(spark, sstable.write_shards(read(spark, sf_dir, "documents"), vocabulary(BYTES)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary(BYTES))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_pages(read(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.text_scores(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_sentencepiece, op4_quality_rules, op5_token_output, op6_simhash, op7_token_counts, op8_decontamination, op9_html_extraction, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": oracles.QUALITY, "op8_decontamination": oracles.CONTAINMENT}
