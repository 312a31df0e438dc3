"""The operators' queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import centroids, common, decontamination, language_model, main_text, ngram_join, packing, pii, quality_classifier, quality_rules, sharding, source_divergence, token_counts, warc

TOKENIZER, CAPACITY = "byte_bpe_50k.json", 2048


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(common.read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path(TOKENIZER))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(common.read(spark, sf_dir, "documents"))
    # The contract fixes the counts, so they are those of the base spans, as base_sha256 is; ``spans`` has the model's too.
    counts = [pii.base_count(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest(base_only=True), 256).alias("base_sha256"), pii.digest().alias("spans"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(common.read(spark, sf_dir, "documents"), width=3, percent=90)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(common.read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.read(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """The packing of documents, as the query and the pipeline return it."""
    cut = common.written(packing.pieces(docs, public_tokenizers.path(TOKENIZER), CAPACITY), "pieces")
    placed = packing.pack(cut, CAPACITY)
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archived(common.read(spark, sf_dir, "pages"), common.fresh_path(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = quality_classifier.scored(docs, quality_classifier.trained(docs, common.read(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return found.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontamination.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audited(common.read(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(common.read(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", centroids.digest("centroid")).drop("centroid")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(common.read(spark, sf_dir, "pages"))


#: The operators' queries by number.
ALL = (
    op1_language_model,
    op2_token_counts,
    op3_pii,
    op4_ngram_join,
    op5_sharding,
    op6_packing,
    op7_quality_rules,
    op8_warc,
    op9_quality_classifier,
    op10_decontamination,
    op11_source_divergence,
    op12_centroids,
    op13_main_text,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_sharding": sharding.ORACLE_SQL,
        "op8_warc": warc.ORACLE_SQL,
        "op11_source_divergence": source_divergence.ORACLE_SQL,
        "op12_centroids": centroids.ORACLE_SQL,
    }
