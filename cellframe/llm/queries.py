"""Registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm import (
    bpe_automaton, capture_index, decontaminate, line_dedup, merkle_manifest, ngram_join, secret_scan, seed_extend, shards, spot_signatures, token_codes,
    toxicity, whitening,
)

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.read(token_codes.write(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    base = F.sha2(secret_scan.labelled(secret_scan.KINDS[:3]).cast("binary"), 256)
    return found.select("doc_id", n("assign"), n("access"), n("hex"), base.alias("base_sha256"), secret_scan.labelled(secret_scan.KINDS).alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index.read(capture_index.write(table(spark, sf_dir, "pages")))


def op9_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_extend.kept_words(table(spark, sf_dir, "documents")).drop("spans")


def op10_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.against_next(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents"), least_documents=10, least_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle_manifest.proofs(docs, {"n_chars": tampered})


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_codes, op2_secret_scan, op3_decontamination, op4_ngram_join, op5_bpe_automaton, op6_toxicity, op7_shards, op8_capture_index,
        op9_seed_extend, op10_spot_signatures, op11_line_dedup, op12_merkle_manifest, op13_whitening,
    )
}
