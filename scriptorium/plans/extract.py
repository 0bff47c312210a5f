"""The extraction pipeline: documents to entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import flatten_special, is_special, prompt, trim_long
from ..operators import chunk, dedup, parse
from ..operators.annotate import fan_out


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents, with the texts of special files (by file_name, else doc_name) flattened."""
    name = F.col("file_name") if "file_name" in docs.columns else F.col("doc_name")
    return docs.withColumn("text", flatten_special(F.col("text"), is_special(name)))


def prompts(docs: DataFrame, max_tokens: int = chunk.MAX_TOKENS, overlap_tokens: int = chunk.OVERLAP_TOKENS, whole_document: bool = False) -> DataFrame:
    """Chunks with their prompts. Single chunks and whole documents go without a header; the latter are trimmed.

    Special files are flattened first.
    """
    if whole_document:
        text = trim_long(F.col("text"))
        rest = [c for c in docs.columns if c != "text"]
        return cleaned(docs).filter(F.length("text") > 0).select(*rest, F.lit(0).alias("chunk_idx"), F.lit(1).alias("n_chunks"), F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("chunk"), text.alias("prompt"))
    return _headed(docs, chunk.chunks(cleaned(docs), max_tokens, overlap_tokens))


def _headed(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """Chunks of docs with their prompts."""
    name = F.col("file_name") if "file_name" in docs.columns else F.col("doc_name")
    header = prompt(F.col("chunk"), F.col("chunk_idx") + 1, F.col("n_chunks"), name)
    return cut.withColumn("prompt", F.when(F.col("n_chunks") == 1, F.col("chunk")).otherwise(header))


def extract(docs: DataFrame, annotator, max_tokens: int = chunk.MAX_TOKENS, overlap_tokens: int = chunk.OVERLAP_TOKENS, bronze: str | None = None, whole_document: bool = False, **parser: bool) -> DataFrame:
    """Entities of documents (doc_id, doc_name, text). bronze: where raw responses are written first, as a model server's must be.

    annotator: one, or a list of them for several models. Documents of one chunk keep all their entities, so those take
    a way of their own, without the shuffle and sort of dedup.
    """
    ask = lambda asked: fan_out(asked, annotator) if isinstance(annotator, list) else annotator.annotate(asked)
    long = lambda raw: parse.long(parse.parse(raw, **parser)).select("model", "doc_id", "doc_name", "chunk_idx", "n_chunks", "entity_idx", "text", "label")
    if whole_document:
        raw = [ask(prompts(docs, whole_document=True))]
    else:
        clean = cleaned(docs)
        raw = [ask(_headed(docs, chunk.whole(clean, max_tokens))), ask(_headed(docs, chunk.parts(clean, max_tokens, overlap_tokens)))]
    if bronze:
        reduce(DataFrame.unionByName, raw).write.mode("overwrite").parquet(bronze)
        written = docs.sparkSession.read.parquet(bronze)
        raw = [written.filter("n_chunks = 1"), written.filter("n_chunks > 1")]
    single, *several = map(long, raw)
    return reduce(DataFrame.unionByName, [single, *map(dedup.dedup, several)])
