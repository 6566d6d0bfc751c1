"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomtide.llm import decontaminate, jaccard, language, mixing, sharding
from roomtide.session import fresh_path, remove, scratch, tune


def prepare(spark: SparkSession) -> None:
    """Settings of every stage. Whole documents go to Python in batches that rows alone would let grow to tens of MB."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; what the classifier rejects goes."""
    prepare(spark)
    return language.keep_recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked at five words and 0.8: the one with the smallest id."""
    prepare(spark)
    return jaccard.keep_one(docs, shingle=5, threshold=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    prepare(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources reach their target weights."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def sharding_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard each goes to; equal texts share one."""
    prepare(spark)
    return sharding.sharded_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding_plan),
]

ORACLE_SQL = None  # a trained classifier comes first, which SQL cannot express; each stage is tested by itself


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder.

    What a stage writes on its way is removed when its result is written, and a
    result when its successor is. The last table stays, or goes with the
    caller's ``scratch`` block.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = fresh_path(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = folder
    return docs
