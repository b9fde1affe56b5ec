"""The queries of this subpackage, by name; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, language_id, lm_score, mixing, near_dup, pii, quality, sharding, toxicity, warc


NEAR = near_dup.NearDupParams(shingle=3, percent=85)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels, trainable = table(spark, sf_dir, "labels"), id_fold(5) != 0
    toxic, ordinary = toxicity.labelled_sample(docs, labels, trainable)
    scored = toxicity.score(docs, toxicity.train(toxic, ordinary, share=toxicity.toxic_share(docs, labels, trainable)))
    return scored.select("doc_id", (id_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_windows")


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), sharding.ShardParams(shards=16))
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), NEAR)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"), id_fold(10) != 0)
    return found.select("doc_id", (id_fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs, id_fold(4) != 2))
    # The contract wants a learned language of every text with a letter; what the distance rejects is told beside it.
    return found.select("doc_id", (id_fold(4) == 2).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return found.select("doc_id", *quality.STATS, "base_failed", "kept", F.pow(F.lit(10.0), "log_ppl").alias("perplexity"))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "status")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.measured(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    shards = F.array_join(F.transform("_copies", lambda c: c["shard"].cast("string")), ",")
    return mixing.plan(docs).select("doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), shards.alias("shards"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_external_shuffle, op3_near_duplicates, op4_lm_score, op5_pii, op6_language_id, op7_decontaminate, op8_quality_rules, op9_warc_segments, op10_mix_sources)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": near_dup.oracle(NEAR), "op9_warc_segments": warc.oracle(), "op10_mix_sources": mixing.oracle()}
