"""Evaluation of models against ground truth, by position or by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import eval_key


def present(predicted: DataFrame, names: list[str]) -> DataFrame:
    """model, label of the columns that a model has: those with a cell that is not null, blank or not."""
    has = F.array_compact(F.array(*[F.when(F.count(F.col(f"`{n}`")) > 0, F.lit(n)) for n in names]))
    return predicted.groupBy("model").agg(has.alias("_has")).select("model", F.explode("_has").alias("label"))


def align(truth: DataFrame, predicted: DataFrame, names: list[str], align: str = "position", blank_is_null: bool = False) -> DataFrame:
    """model, label, row_idx, gt, pred. Labels that a model lacks are skipped; the longer side is cut.

    A model lacks a label if its column is missing or null throughout. align: "position" pairs rows by row_idx;
    "document" by Document and row number within it. blank_is_null: blank cells become null, as they do in a round
    through a spreadsheet; else they are values.
    """
    mine = [n for n in names if n in predicted.columns]
    if not mine:
        raise ValueError("no column of the predictions is a label of the ground truth")
    known = present(predicted, mine)
    if blank_is_null:
        blank = {n: F.nullif(F.col(f"`{n}`"), F.lit("")) for n in mine}
        truth, predicted = truth.withColumns(blank), predicted.withColumns(blank)
    keys = ["row_idx"]
    if align == "document":
        keys = ["Document", "row_idx"]
        numbered = lambda df, *by: df.filter("Document <> ''").withColumn("row_idx", F.row_number().over(Window.partitionBy(*by, "Document").orderBy("row_idx")).cast("long"))
        truth, predicted = numbered(truth), numbered(predicted, "model")
    # Rows are joined whole, and become cells after that: a third of the rows to shuffle and sort, with three labels.
    g = truth.select(*keys, F.struct(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(mine)]).alias("_g"))
    p = predicted.select("model", *keys, F.struct(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(mine)]).alias("_p"))
    cells = F.array(*[F.struct(F.lit(n).alias("label"), F.col("_g")[f"c{k}"].alias("gt"), F.col("_p")[f"c{k}"].alias("pred")) for k, n in enumerate(mine)])
    both = p.join(g, keys).select("model", *keys, F.inline(cells))
    return both.join(F.broadcast(known), ["model", "label"], "left_semi").select("model", "label", *keys, "gt", "pred")  # a row for each model and label


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1_score")]


def by_label(aligned: DataFrame) -> DataFrame:
    """Metrics of each model and label. Pairs of two nulls are no samples; a substitution is both FP and FN."""
    g, p = eval_key(F.col("gt")), eval_key(F.col("pred"))
    valid = aligned.withColumn("valid", ~(F.col("gt").isNull() & F.col("pred").isNull())).withColumns({"g": g, "p": p})
    on = lambda test: F.count_if(F.col("valid") & test)
    counts = valid.groupBy("model", "label").agg(
        F.count_if("valid").alias("num_samples"),
        on(F.expr("g = p")).alias("hits"),
        on(F.expr("g = p AND g <> ''")).alias("true_positives"),
        on(F.expr("p <> '' AND g <> p")).alias("false_positives"),
        on(F.expr("g <> '' AND g <> p")).alias("false_negatives"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return counts.select(F.col("label").alias("entity_type"), "model", ratio(F.col("hits"), F.col("num_samples")).alias("exact_match"), *_scores(tp, fp, fn), "num_samples", "true_positives", "false_positives", "false_negatives")


def macro(metrics: DataFrame) -> DataFrame:
    """Unweighted mean over the labels that have samples."""
    return metrics.filter("num_samples > 0").groupBy("model").agg(*[F.avg(c).alias(c) for c in ("exact_match", "precision", "recall", "f1_score")])


def micro(metrics: DataFrame) -> DataFrame:
    """Metrics from the sums over all labels."""
    total = metrics.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("true_positives", "false_positives", "false_negatives")])
    return total.select("model", *_scores(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")), "true_positives", "false_positives", "false_negatives")


def _first(k: int):
    """For mapInArrow: of all batches, the k least row_idx of each model and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rows = new if kept is None else pa.concat_tables([kept, new])
            order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("model", "label", "row_idx")], null_placement="at_start").to_numpy()
            m, la = (rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()[order] for c in ("model", "label"))
            new_group = np.r_[True, (m[1:] != m[:-1]) | (la[1:] != la[:-1])][: len(order)]
            at = np.arange(len(order))
            rank = at - np.maximum.accumulate(np.where(new_group, at, 0))
            kept = rows.take(pa.array(order[rank < k])).combine_chunks()
        if kept is not None:
            yield from kept.to_batches()

    return run


def examples(aligned: DataFrame, k: int = 5) -> DataFrame:
    """The first k pairs of each model and label of which a side is not blank, and whether they agree.

    Each task keeps its own first k as its rows pass, so that none sorts or holds them; the window sees only those.
    """
    g, p = eval_key(F.col("gt")), eval_key(F.col("pred"))
    some = aligned.filter((g != "") | (p != "")).select("model", "label", F.col("row_idx").cast("long").alias("row_idx"), "gt", "pred")
    first = some.mapInArrow(_first(k), some.schema)
    w = Window.partitionBy("model", "label").orderBy("row_idx")
    return first.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("model", "label", "n", "row_idx", "gt", "pred", (g == p).alias("agrees"))
