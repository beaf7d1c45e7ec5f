"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents.  Rows without a doc_id pass the stages that go by documents and end at mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontam, language_id, mixing, ngram_join, suffix_dedup
from quillmark.llm import kernels as K

#: A text is rejected if no language is nearer than this cosine; clean texts of any learned language are far above.
MIN_LANGUAGE_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, and those like no language."""
    K.small_batches(spark)
    model = language_id.fit(docs)
    if not model[0]:  # nothing to learn from: only texts without a letter can be told
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return language_id.identify(docs, model).where(F.col("score") >= MIN_LANGUAGE_SCORE).where("lang_pred <> 'und'").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays."""
    more = ngram_join.jaccard_join(docs, count_links=False).where("component_id <> doc_id").select("doc_id")
    return docs.join(more, "doc_id", "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 100 bytes and more that stand earlier; documents of which nothing is left go."""
    kept = suffix_dedup.dedup_windows(docs.withColumn("no_text_", F.col("text").isNull()), whole_chars=True, keep=[c for c in docs.columns if c != "text"] + ["no_text_"])
    kept = kept.where("n_removed < n_bytes or n_bytes = 0")
    text = F.when(~F.col("rest.no_text_"), F.col("kept").cast("string"))
    own = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[own[c].alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    hit = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents, a row for each epoch."""
    rows, repeated = K.keyed(docs, "doc_id", "text")
    taken = K.stored(mixing.mix(rows, doc_id="row_key_") if repeated else mixing.mix(docs), "pipeline-mix").select(F.col("doc_id").alias("row_key_"), "domain", "n_tokens", "epoch")
    return rows.join(taken, "row_key_").select(*docs.columns, "domain", "n_tokens", "epoch")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express hash orders, learned profiles and token prefixes; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = K.written()
        docs = K.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        K.clear(spark, since, keep=docs.stored_path)
    return docs
