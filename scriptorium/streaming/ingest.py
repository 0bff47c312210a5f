"""Streaming extraction: text files in, entities out, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import newlines, stem
from ..operators import chunk, dedup, parse
from ..plans.extract import prompts
from ..sources.files import decoded, file_name


def text_stream(spark: SparkSession, path: str, pattern: str = "*.txt", per_trigger: int = 1000) -> DataFrame:
    """file_name, stem, text of files as they arrive."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    named = raw.select(file_name(decoded(F.col("_metadata.file_path"))).alias("file_name"), newlines(F.try_validate_utf8("value")).alias("text")).filter(F.length("text") > 0)
    return named.select("file_name", stem(F.col("file_name")).alias("stem"), "text")


def extract_stream(docs: DataFrame, annotator, out: str, checkpoint: str, max_tokens: int = chunk.MAX_TOKENS, overlap_tokens: int = chunk.OVERLAP_TOKENS) -> StreamingQuery:
    """Writes raw responses and entities of every batch under `out`, bronze first, so that models are asked once.

    A batch that is tried again writes the same folder again: one folder for each batch.
    """

    def batch(df: DataFrame, n: int) -> None:
        keyed = df.withColumns({"doc_id": F.xxhash64("file_name"), "doc_name": F.col("stem")})
        annotator.annotate(prompts(keyed, max_tokens, overlap_tokens)).write.mode("overwrite").parquet(f"{out}/bronze/batch={n}")
        bronze = df.sparkSession.read.parquet(f"{out}/bronze/batch={n}")
        dedup.dedup(parse.long(parse.parse(bronze))).drop("chunk", "prompt").write.mode("overwrite").parquet(f"{out}/entities/batch={n}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
