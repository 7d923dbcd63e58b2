"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, line_dedup, lm_scoring, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, url_filter
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the cascade for all documents."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = lm_scoring.held_out("doc_id", 1)
    fitted = lm_scoring.fit(docs.where(~held).select("text"))
    scored = lm_scoring.score(docs, fitted)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(fitted[1]["total"]).cast("long").alias("train_tokens"), "base_score", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of all pages."""
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"), F.col("_score").alias("score"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without bytes that strings of 200 bytes cover which start elsewhere."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many documents share, dropped from all documents."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines_total").alias("n_lines"), F.col("_lines_dropped").alias("n_dropped"), F.sha2(F.encode("_lines_kept", "UTF-8"), 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality scores of all documents, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = lm_scoring.held_out("doc_id", 0)
    labels = table(spark, sf_dir, "labels").where(~held).select("doc_id", "quality")
    scored = quality_classifier.classify(docs, quality_classifier.fit_classifier(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of each document that the mixture takes, with its place in the epoch."""
    _, picks = mixing.mix(table(spark, sf_dir, "documents"))
    return picks.select(F.col("id").alias("doc_id"), "source", "n_tokens", "epoch", "block_rank", "row_rank")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=64, max_distance=4, pieces=6)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_url_filter": op4_url_filter,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
}
