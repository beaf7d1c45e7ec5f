"""Queries opN_<name>: each operator with its production parameters over its whole table.

SQL can't express them on whole tables (hash orders, library tokenizers, iteration, learned models); each is held
against brute force or held-out truth in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontam, html_extract, language_id, license_scan, lm_scoring, mixing, ngram_join, suffix_dedup, token_counts, vector_search
from quillmark.llm import kernels as K

TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    K.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts.token_counts(docs, keep=["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), K.crc_mod("doc_id", 7) == 2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = K.crc_mod("doc_id", 5) == 0
    model = language_id.fit(docs, train=~held)
    return language_id.identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontaminate, op2_suffix_dedup, op3_token_counts, op4_license_scan, op5_html_text, op6_lm_score, op7_language_id, op8_mix_sources, op9_vector_search, op10_jaccard_join)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
