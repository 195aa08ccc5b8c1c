"""The corpus pipeline: quality rules, near-dedup, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
shared folder and reads it back for the next stage. All but the last return the columns of documents, extra ones
included, whatever their names.

Null and empty texts, and all of under 50 words, fail the quality rules and go. Of repeated rows, and of documents that
differ in id alone, one is left: that with the least id, one without an id only if all are. Labels and items that are
null or disagree are treated as the stages' docstrings say. Without labels the base rules alone decide, without a benchmark
nothing leaks, and an empty documents table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import decontaminate, packing, pii, quality_rules, simhash
from strandweave.llm.common import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("PII", personal_data), ("packing", pack)]

#: Trained ratios, fingerprints and tokenizers are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs
