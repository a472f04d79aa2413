"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf, licences, logbilinear, mih, packing, quality, sharding, simhash, toxicity
from .common import table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.languages(table(spark, sf_dir, "documents"))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbilinear.score(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.expr(licences.PATH).alias("path"), "text")
    return licences.scan(files).withColumnRenamed("file_id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository top, beside the package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op9_licences": op9_licences,
    "op1_language_crf": op1_language_crf,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op8_log_bilinear": op8_log_bilinear,
    "op2_toxicity": op2_toxicity,
    "op6_simhash": op6_simhash,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op3_quality_rules": op3_quality_rules,
    "op5_byte_bpe": op5_byte_bpe,
}

ORACLE_SQL = {
    "op9_licences": licences.oracle_sql(),
    "op3_quality_rules": quality.oracle_sql(),
}
