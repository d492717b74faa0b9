"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf_langid, decontaminate, fill_middle, fingerprints, interpolated_lm, packing, reply_trees, setsketch, sharding, spelling_variants, suffix_dedup, toxicity, viterbi_counts
from .common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(True))
    found = crf_langid.identify(docs, docs.where(~held_out & F.col("lang").isNotNull()))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_counts.token_counts(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs.withColumn("slot", sharding.slot_of(F.col("doc_id"))))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(True))
    labels = _table(spark, sf_dir, "labels").where(~held_out)
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_documents(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents")))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reply_trees.chains(reply_trees.with_planted(_table(spark, sf_dir, "conversations")))
    return reply_trees.digest(reply_trees.format_trees(rows, tree="conv_id", score=None))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_token_counts, op3_sharding, op4_near_dedup, op5_toxicity, op6_packing, op7_fingerprints, op8_decontamination, op9_lm_scoring, op10_suffix_dedup, op11_fill_middle, op12_chat_format, op13_spelling_variants)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": sharding.oracle_sql(),
        "op4_near_dedup": setsketch.ORACLE_SQL,
        "op8_decontamination": decontaminate.ORACLE_SQL,
        "op10_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op11_fill_middle": fill_middle.ORACLE_SQL,
        "op12_chat_format": reply_trees.ORACLE_SQL,
        "op13_spelling_variants": spelling_variants.ORACLE_SQL,
    }
