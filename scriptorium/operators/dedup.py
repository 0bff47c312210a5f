"""Entity dedup over the chunks of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def dedup(entities: DataFrame, keys: tuple[str, ...] = ("model", "doc_id"), dedup_single: bool = False) -> DataFrame:
    """The first of entities that agree on key, lower-case stripped text and label; blank ones go.

    Documents of one chunk (n_chunks = 1) stay as they are unless dedup_single. Texts stay unstripped.
    """
    name = F.lower(strip(F.col("text")))
    first = Window.partitionBy(*keys, name, "label").orderBy("chunk_idx", "entity_idx")
    multi = F.lit(True) if dedup_single else F.col("n_chunks") > 1
    named = (F.length(strip(F.col("text"))) > 0) & (F.length("label") > 0)
    ranked = entities.withColumn("_k", F.row_number().over(first))
    return ranked.filter(~multi | (named & (F.col("_k") == 1))).drop("_k")
