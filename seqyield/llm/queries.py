"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqyield.llm import (conversation_repair, exact_dedup, filter_audit, html_text, minhash_dedup, mixing, nearest,
                          ngram_lm, packing, quality, secrets, simhash_dedup, substring_dedup)
from seqyield.llm.common import crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    train = quality.training_rows()
    model = quality.fit(docs, labels, train)
    return quality.with_scores(docs.select("doc_id", "text"), model).select(
        "doc_id", (~train).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target",
        (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 5) == 1
    scored = ngram_lm.scores(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.report(rows, conversation_repair.damage(rows))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicate_classes(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_mix": op3_mix,
    "op4_lm_score": op4_lm_score,
    "op5_html_text": op5_html_text,
    "op6_pack": op6_pack,
    "op7_nearest": op7_nearest,
    "op8_simhash": op8_simhash,
    "op9_secrets": op9_secrets,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_minhash": op13_minhash,
}
