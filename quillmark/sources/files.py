"""Sources and sinks (S5-S7, S12-S19, S21, S24, K6, K10, K16-K18): folders, sidecars, keys, manifests, code sets; NDJSON and metrics text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.functions.text import ignore_reason, mime_of, words_only


def folder(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Files with name, stem, sha256, media type and the reason to leave them alone."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", "modificationTime", F.sha2("content", 256).alias("sha256"), mime_of(F.col("content")).alias("mime"), ignore_reason(name).alias("ignored"), "content")


def with_sidecars(files: DataFrame, sidecars: DataFrame, stem: str = "stem") -> DataFrame:
    """Each file with the JSON beside it of the same stem, if any."""
    return files.join(sidecars, stem, "left")


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object a line, such as an answer key; unreadable lines in _corrupt_record if the schema has it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def json_by_stem(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A folder of JSON documents, one a file, keyed by the file's stem."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", "true").json(path)
    return df.withColumn("stem", F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.[^.]*$", ""))


def line_crops(spark: SparkSession, manifest: str, crops: str) -> DataFrame:
    """Lines (file, truth) of a JSONL manifest with the bytes of their crops; lines without a crop are left out."""
    lines = jsonl(spark, manifest, "file string, truth string").withColumn("name", F.element_at(F.split("file", "/"), -1))
    files = folder(spark, crops).select("name", "content", "sha256")
    return lines.join(files, "name").select("name", "truth", "sha256", "content")


def code_set(spark: SparkSession, path: str, code: str, names: list[str], separator: str = "\t") -> DataFrame:
    """An index of a code set (delimited text with a header, packed or not): each name, normalised, with its codes in order."""
    raw = spark.read.option("header", "true").option("sep", separator).csv(path)
    one = raw.select(F.trim(code).alias("code"), F.explode(F.array(*[F.col(c) for c in names])).alias("name")).withColumn("name", words_only(F.col("name")))
    return one.where("name <> '' and code <> ''").groupBy("name").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def catalogue_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the session's catalog with their columns, in order."""
    rows = [(t.name, c.name, c.dataType, i) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, ordinal int").orderBy("table_name", "ordinal")


def catalogue(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header, byte-order mark tolerated, values trimmed."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").schema(schema).csv(path)
    return df.select(*[F.trim(F.regexp_replace(f.name, "^﻿", "")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-cased words, comments and blanks left out."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> '' and not word like '#%'").distinct()


def write_children(df: DataFrame, path: str, key: str) -> None:
    """Rebuilds the partitions of the keys in df and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line, fields in column order."""
    df.write.mode("overwrite").json(path)


def metrics_text(df: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """Exposition lines `metric{label="x"} value`."""
    pairs = [F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels]
    return df.select(F.concat(F.lit(metric + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string")).alias("line"))
