"""Overlapping chunks of long texts, cut after a sentence, a paragraph or a word."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN, rfind, token_estimate

MAX_TOKENS, OVERLAP_TOKENS, LOOK_BACK = 12_000, 500, 1000
BOUNDS = "array<struct<chunk_idx:int,start:int,end:int>>"


def cuts(text: str, width: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each chunk. The cut is sought in the last 1000 characters of the window."""
    out, at, n = [], 0, len(text)
    while at < n:
        stop = at + width
        if stop >= n:
            out.append((at, n))
            break
        low = max(at, stop - LOOK_BACK)
        sentence, paragraph = text.rfind(". ", low, stop), text.rfind("\n\n", low, stop)
        if max(sentence, paragraph) >= 0:
            stop = max(sentence, paragraph) + 2
        elif (blank := text.rfind(" ", low, stop)) >= 0:
            stop = blank + 1
        out.append((at, stop))
        at = max(at + 1, stop - overlap)
    return out


def bounds(text: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """Chunk bounds of a text, by an Arrow function: each start depends on the cut before, so it is a small loop."""
    width, overlap = CHARS_PER_TOKEN * max_tokens, CHARS_PER_TOKEN * overlap_tokens

    @F.pandas_udf(BOUNDS)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: [{"chunk_idx": i, "start": a, "end": b} for i, (a, b) in enumerate(cuts(t or "", width, overlap))])

    return run(text)


def bounds_native(text: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """The same without Python: a fold over as many steps as there can be chunks."""
    width, overlap = CHARS_PER_TOKEN * max_tokens, CHARS_PER_TOKEN * overlap_tokens
    n, stride = F.length(text), max(1, width - LOOK_BACK - overlap)
    steps = F.sequence(F.lit(1), F.ceil(n / stride).cast("int") + 1)

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        stop = at + width
        low = F.greatest(at, stop - LOOK_BACK)
        window = F.substring(text, low + 1, stop - low)
        s, p, b = rfind(window, ". "), rfind(window, "\n\n"), rfind(window, " ")
        end = F.when(stop >= n, n).when((s != -1) & (s > p), low + s + 2).when(p != -1, low + p + 2).when(b != -1, low + b + 1).otherwise(stop)
        new = F.array_append(acc["out"], F.struct(F.size(acc["out"]).alias("chunk_idx"), at.alias("start"), end.cast("int").alias("end")))
        after = F.when(stop >= n, n).otherwise(F.greatest(at + 1, end - overlap)).cast("int")
        return F.when(at < n, F.struct(after.alias("at"), new.alias("out"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {BOUNDS})").alias("out"))
    return F.when(n > 0, F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(F.expr(f"CAST(array() AS {BOUNDS})"))


def is_small(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Whether a text goes to the model whole."""
    return token_estimate(text) <= max_tokens


def whole(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The small texts of chunks(), each one chunk: native, and one for each document."""
    rest = [c for c in docs.columns if c != "text"]
    small = docs.filter(is_small(F.col("text"), max_tokens) & (F.length("text") > 0))
    return small.select(*rest, F.lit(0).alias("chunk_idx"), F.lit(1).alias("n_chunks"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("chunk"))


def parts(docs: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, native: bool = False) -> DataFrame:
    """The chunks of the large texts of chunks(); only those cross to Python."""
    rest = [c for c in docs.columns if c != "text"]
    large = docs.filter(~is_small(F.col("text"), max_tokens))
    cut = bounds_native(F.col("text"), max_tokens, overlap_tokens) if native else bounds(F.col("text"), max_tokens, overlap_tokens)
    both = large.withColumn("_cuts", cut).withColumn("n_chunks", F.size("_cuts"))
    each = both.select(*rest, "text", "n_chunks", F.inline_outer("_cuts")).filter("chunk_idx IS NOT NULL")  # a plain inline would cut twice
    return each.select(*rest, "chunk_idx", "n_chunks", "start", "end", F.expr("substring(text, start + 1, end - start)").alias("chunk"))


def chunks(docs: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, native: bool = False) -> DataFrame:
    """One row for each chunk: the columns of docs but text, and chunk_idx, n_chunks, start, end, chunk. Small texts are one chunk.

    Only large texts cross to Python; the native fold does without it, several times slower.
    """
    return whole(docs, max_tokens).unionByName(parts(docs, max_tokens, overlap_tokens, native))
