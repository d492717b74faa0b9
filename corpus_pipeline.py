"""The corpus pipeline: each stage takes all documents that the one before kept.

A stage is ``f(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet in the
shared folder and read back as the next one's ``docs``; a stage's own tables, and the result
before, are deleted then. All but the last return the columns of ``documents``. Null texts and
texts without a letter go in the first stage; rows repeated whole go in the second; an empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from biblion.llm import crf_langid, decontaminate, packing, setsketch, suffix_dedup
from biblion.llm.common import discard, materialize, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the CRF can tell; ``und`` and undecided ones go."""
    return crf_langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least doc_id, of each near-duplicate group."""
    return setsketch.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of long strings that start earlier too; texts left empty go."""
    return suffix_dedup.remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences."""
    return packing.best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The model stages and the packing are beyond SQL; tests/llm/test_stages.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return docs
