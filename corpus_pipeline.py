"""The corpus pipeline: raw documents to packed training sequences.

STAGES are applied in order; each takes (spark, docs, sf_dir), works on all rows
that its predecessor kept, and its result is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.
Each stage treats nulls, empty texts, repeated rows and empty tables as the
operator that it calls says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import line_dedup, mixing, packing, quality_rules, simhash
from factloom.llm.common import materialise
from factloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of smaller sources again, up to twice."""
    return mixing.mixed_documents(docs, target_entropy=0.95, max_repeat=2.0)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in all."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("mixing", mixture), ("packing", sequences)]

#: Tokens, fingerprints and packing are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
