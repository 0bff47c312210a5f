"""Readers of text files, entity JSON, authority databases and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import newlines, stem
from . import ranges


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def decoded(uri: Column) -> Column:
    """A URI without percent escapes; the file metadata column has them, the path column of binary files does not."""
    return F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))


def _binary(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    """path, content of files. Spark passes over names that begin with _ or a dot; those are listed apart and read as well."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    df = (reader.option("recursiveFileLookup", "true") if recursive else reader).load(path).select("path", "content")
    more = ranges.hidden(spark, path, pattern, *(["*/" + pattern] if recursive else []))
    return df.unionByName(ranges.whole(spark, more)) if more else df


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt", keep_bad: bool = False) -> DataFrame:
    """file_name, stem, text of UTF-8 files. Line ends become line feeds.

    Files that are not UTF-8 go; with keep_bad they have an empty text, as reports want them. Spark skips empty files.
    """
    df = _binary(spark, path, pattern).select(file_name(F.col("path")).alias("file_name"), newlines(F.try_validate_utf8(F.decode("content", "UTF-8"))).alias("text"), F.try_validate_utf8(F.col("content").cast("string")).isNotNull().alias("_ok"))
    df = df.withColumn("text", F.when(F.col("_ok"), F.col("text")))
    df = df.withColumn("text", F.coalesce("text", F.lit(""))) if keep_bad else df.filter(F.length("text") > 0)
    return df.select("file_name", stem(F.col("file_name")).alias("stem"), "text")


def entity_files(spark: SparkSession, path: str, pattern: str = "*_entities.json") -> DataFrame:
    """model (the folder), doc_name, raw_response of entity JSON files, one folder for each model."""
    df = _binary(spark, path, pattern, recursive=True)
    name = file_name(F.col("path"))
    return df.select(F.element_at(F.split("path", "/"), -2).alias("model"), F.replace(name, F.lit("_entities.json"), F.lit("")).alias("doc_name"), F.try_validate_utf8(F.col("content").cast("string")).alias("raw_response"))


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """base, raw_response of any JSON files; the base is the stem without _entities."""
    df = _binary(spark, path, "*.json")
    return df.select(F.replace(stem(file_name(F.col("path"))), F.lit("_entities"), F.lit("")).alias("base"), F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit("")).alias("raw_response"))


def authority_items(spark: SparkSession, path: str, size: int = ranges.RANGE) -> DataFrame:
    """db_idx, item (variant) of a JSON array, or of JSON lines where the path ends with .jsonl; a file, or a folder of them.

    Both are read by ranges of `size` bytes, one array by many tasks. db_idx is the place in the file, and files of a
    folder follow each other by name. What is no JSON goes. In a store that only Spark reads, an array is one task's work,
    and lines are numbered in order but not densely.
    """
    lines = path.rstrip("/").endswith(".jsonl")
    if ranges.reachable(spark, path):
        found = ranges.read(spark, path, "lines" if lines else "array", size)
    elif lines:
        found = spark.read.text(path).filter(F.length("value") > 0).select(F.monotonically_increasing_id().alias("db_idx"), "value")
    else:
        whole = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>").alias("items"))
        return whole.select(F.posexplode("items").alias("db_idx", "item")).withColumn("db_idx", F.col("db_idx").cast("long"))
    return found.select("db_idx", F.try_parse_json("value").alias("item")).filter("item IS NOT NULL")


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings from CSV or Parquet. Nothing is inferred, so years stay texts."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`") if c == "row_idx" else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet file, as strings with row_idx, where pandas has an engine for it."""
    import pandas as pd

    pdf = pd.read_excel(path, dtype=str, keep_default_na=False).replace({"": None})
    pdf.insert(0, "row_idx", range(len(pdf)))
    return spark.createDataFrame(pdf)
