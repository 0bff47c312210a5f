"""Wide tables: the i-th entity of each label on row i of its document, and a blank row after each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stored


def labels(entities: DataFrame) -> DataFrame:
    """Distinct labels of each model."""
    return entities.select("model", "label").distinct()


def per_document(entities: DataFrame) -> DataFrame:
    """Entity counts."""
    return entities.groupBy("model", "doc_name").agg(F.count("*").alias("n_entities"))


def running(sizes: DataFrame) -> DataFrame:
    """Adds start, the sum of n over the model's documents before this one, without one task per model.

    Documents are dealt out by ranges of names; sums within a range are shifted by the totals of the ranges before.
    """
    ranged = cut(sizes.repartitionByRange("model", "doc_name").withColumn("_part", F.spark_partition_id()))  # the cut fixes the ranges
    before = Window.partitionBy("model").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("model", "_part").agg(F.sum("n").alias("_n")).select("model", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("model", "_part").orderBy("doc_name").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(shift, ["model", "_part"]).select("model", "doc_name", "n", (F.col("_shift") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("start"))


def wide(entities: DataFrame, names: list[str], documents: DataFrame | None = None, own_labels: bool = False) -> DataFrame:
    """model, row_idx, Document and a column for each name. `documents` (model, doc_name) adds those without entities.

    Rows follow document names, which stand for the order of files. A cell without an entity is blank; with own_labels
    it is null where the model has no entity of that label at all, so that a model's table has the labels of that model.
    """
    # A row for each document until its cells are in place: rows of cells are not shuffled.
    of = lambda n: F.array_sort(F.collect_list(F.when(F.col("label") == n, F.struct("chunk_idx", "entity_idx", "text"))))
    cells = [f"_c{k}" for k in range(len(names))]
    body = entities.filter(F.col("label").isin(names)).groupBy("model", "doc_name").agg(*[of(n).alias(c) for c, n in zip(cells, names, strict=True)])
    body = body.select("model", "doc_name", F.greatest(*map(F.size, cells), F.lit(0)).cast("long").alias("_n"), *[F.transform(c, lambda e: e["text"]).alias(c) for c in cells])
    body = stored(body, "cells")  # read twice; what made the entities may be dear
    known = (documents if documents is not None else entities).select("model", "doc_name").distinct()
    sizes = known.join(body.select("model", "doc_name", "_n"), ["model", "doc_name"], "left").select("model", "doc_name", (F.coalesce("_n", F.lit(0)) + 1).alias("n"))
    placed = running(sizes).join(body, ["model", "doc_name"], "left")
    # The last row of a document, past its cells, is blank.
    rows = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_i"))
    rows = rows.select("model", "doc_name", (F.col("start") + F.col("_i")).alias("at"), (F.col("_i") == F.col("n") - 1).alias("_blank"), *[F.get(c, F.col("_i").cast("int")).alias(n) for c, n in zip(cells, names, strict=True)])
    if own_labels:
        own = F.array_compact(F.array(*[F.when(F.max(F.size(c)) > 0, F.lit(n)) for c, n in zip(cells, names, strict=True)]))
        rows = rows.join(F.broadcast(body.groupBy("model").agg(own.alias("_own"))), "model", "left")  # a row for each model
    cell = lambda n: F.coalesce(F.col(f"`{n}`"), F.lit(""))
    has = (lambda n: F.when(F.array_contains("_own", n), cell(n))) if own_labels else cell
    return rows.select("model", F.col("at").cast("long").alias("row_idx"), F.when(F.col("_blank"), "").otherwise(F.col("doc_name")).alias("Document"), *[has(n).alias(n) for n in names])
