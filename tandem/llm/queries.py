"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandem.llm import (
    decontamination, interpolation, jaccard_join, lz_dedup, merkle, mixing, quality_cnn, quality_rules, resharding, sql, suffix_dedup,
    token_counts, toxicity, vector_codes,
)
from tandem.llm.decontamination import ascii_lower
from tandem.llm.labelled import held_out

# Folder of the public tokenizers' vocabulary files, read by the driver.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
OLD_SHARDS, SHARDS = 20, 24


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir, "doc_id", "text")).drop("kept")


def old_shard():
    """The layout that is resharded: texts by hash, so that equal texts lie together."""
    return F.pmod(F.xxhash64("text"), F.lit(OLD_SHARDS))


def op2_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    placed = resharding.reshard(docs, old_shard(), OLD_SHARDS, SHARDS, keep=["doc_id"])
    return placed.select("doc_id", "place.size", "place.text_crc32", F.lit("bytes").alias("law"), "place.shard", "place.slot",
                         F.lit(None).cast("int").alias("grown_shard"), "place.old_shard")


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    net = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_cnn.with_score(docs, net)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_longest_match_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = token_counts.build(token_counts.piece_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model"))
    return token_counts.with_token_count(documents(spark, sf_dir, "doc_id", "text"), automaton).select("doc_id", "n_tokens")


def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "leak.n_words", "leak.n_hit", "leak.n_items", "leak.items_sha256", "leak.contaminated")


def op7_adaptive_prefix_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.with_copies(documents(spark, sf_dir, "doc_id", "source", "text"))
    return counted.select("doc_id", "mix.size", "mix.source_size", "mix.target",
                          (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op9_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_dedup.without_passages(documents(spark, sf_dir, "doc_id", "text")).drop("kept")


def op10_distribution_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(documents(spark, sf_dir, "doc_id", "text"))
    counts = [f"rules.{c.split()[0]}" for c in quality_rules.COUNTS.split(", ")]
    return judged.select("doc_id", *counts, "rules.base_failed", "rules.kept", "rules.class_distance", "rules.common_distance")


def op11_octopus_multiproof(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = documents(spark, sf_dir, *columns)
    tampered = F.when(held_out(), merkle.leaf_digest(docs, columns, {"text": ascii_lower("text")}))
    return merkle.with_proofs(docs, columns, tampered).withColumnRenamed("id", "doc_id")


def op12_gnat_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.with_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.with_scores(documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_min_cost_flow_resharding, op3_toxicity_grammar, op4_byte_cnn_quality,
    op5_longest_match_token_counts, op6_winnowing_decontamination, op7_adaptive_prefix_jaccard_join, op8_source_mixing,
    op9_relative_lz_dedup, op10_distribution_divergence_rules, op11_octopus_multiproof,
    op12_gnat_vector_codes, op13_deleted_interpolation, pipeline)}

ORACLES = {"op6_winnowing_decontamination": sql.DECONTAMINATION, "op8_source_mixing": sql.MIXING,
           "op11_octopus_multiproof": sql.MERKLE, "op12_gnat_vector_codes": sql.VECTOR_CODES}
