"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import decontaminate, jaccard, mixing, quality, simple8b
from cuewright.llm.common import small_batches, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    small_batches(spark)
    weights = quality.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, weights).where(F.col("quality_score") >= quality.THRESHOLD).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (sets of five-word shingles, similarity 0.8 or more)."""
    small_batches(spark)
    return jaccard.keep_one(docs, words=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources have equal shares, in a global shuffle."""
    return mixing.mixed(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids as Simple-8b blocks and report each document's place in the file."""
    small_batches(spark)
    return simple8b.token_table(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copy_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL cannot express the classifier, the latent search or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
