"""Query keys of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, main_text, merkle, mixing, packing, pieces, pii, quality, repair, sharding, simhash, suffix_dedup, toxicity
from ledgerloom.llm.oracles import ORACLES


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.redactions(_documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans")
    )


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir)).drop("row_no")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("_row")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_documents(spark, sf_dir)).drop("_row")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(_documents(spark, sf_dir), {"found": merkle.tampered_leaf()})
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return merkle.verified(rows).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return repair.with_empty(repair.repair(repair.damaged(conversations)).report(), conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_main_text, op2_simhash_near_dedup, op3_suffix_dedup, op4_pii, op5_quality_rules, op6_toxicity, op7_sharding,
        op8_mixing, op9_exact_dedup, op10_sentencepiece, op11_packing, op12_merkle_manifest,
        op13_conversation_repair,
    )
}


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    return dict(QUERIES), dict(ORACLES)
