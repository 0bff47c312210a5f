"""HTML reports: entities highlighted in their text, and a summary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import marking
from ..functions.text import html_escape
from ..session import cut

# Colours of labels.
COLOURS = {
    "DATE": "#FFD700",
    "PERSON": "#FF6347",
    "ORG": "#4682B4",
    "PLACE": "#32CD32",
    "SHIP": "#9370DB",
    "GROUP": "#FF7F50",
    "INDICATION_OF_SLAVERY": "#DC143C",
    "RELATIONSHIPS": "#20B2AA",
}
OTHER = "#CCCCCC"


def no_entities() -> Column:
    """What a text without entities is highlighted with."""
    return F.expr("CAST(array() AS array<struct<entity_idx:int,text:string,label:string>>)")


def colour(label: Column) -> Column:
    """A label's colour."""
    known = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(F.element_at(known, label), F.lit(OTHER))


def successors(wanted: DataFrame, stems: DataFrame) -> DataFrame:
    """base, stem: for each base of `wanted`, the least of `stems` that is not before it in the order of code points.

    An as-of join: both sides are dealt out by ranges of their sort order together, each range is scanned from its end for
    the nearest stem, and what a range does not hold comes from the first stem of the ranges after it. Scans run down the
    order with frames that only grow: a frame that ends with the partition would be read anew for each row.
    """
    # Stems sort after the equal base, so that looking ahead from a base finds an equal stem too.
    both = wanted.select(F.col("base").alias("key"), F.lit(0).alias("is_stem")).unionByName(stems.select(F.col("stem").alias("key"), F.lit(1).alias("is_stem"))).distinct()
    ranged = cut(both.repartitionByRange("key", "is_stem").withColumn("_part", F.spark_partition_id()))  # the cut fixes the ranges
    stem = F.when(F.col("is_stem") == 1, F.col("key"))
    ahead = Window.partitionBy("_part").orderBy(F.desc("key"), F.desc("is_stem")).rowsBetween(Window.unboundedPreceding, 0)
    near = ranged.withColumn("_here", F.last(stem, ignorenulls=True).over(ahead)).filter("is_stem = 0")
    firsts = ranged.groupBy("_part").agg(F.min(stem).alias("_first"))  # a row for each range
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select("_part", F.min("_first").over(later).alias("_after"))
    return near.join(after, "_part").select(F.col("key").alias("base"), F.coalesce("_here", "_after").alias("stem"))


def pair(reports: DataFrame, texts: DataFrame) -> DataFrame:
    """reports (base) with texts (stem): the text of the same stem, else the first whose stem starts with the base.

    The least stem that starts with a base is the base's successor among the stems, if any stem starts with it: so the
    fallback is one sort of both sides, and not a row for each beginning of each stem.
    """
    exact = reports.join(texts, F.col("base") == F.col("stem"))
    rest = reports.join(texts.select("stem"), F.col("base") == F.col("stem"), "left_anti")
    near = successors(rest.select("base").distinct(), texts.select("stem")).filter(F.startswith("stem", F.col("base"))).withColumnRenamed("stem", "_s")
    return exact.unionByName(rest.join(near, "base").join(texts, F.col("_s") == F.col("stem")).drop("_s"))


def longest_first(entities: Column) -> Column:
    """Entities by length of text, longest first, ties as they were."""
    ranked = F.transform(entities, lambda e, i: F.struct((-F.length(e["text"])).alias("k"), i.alias("i"), e["text"].alias("text"), e["label"].alias("label")))
    return F.array_sort(ranked)


#: Bytes of texts that are Python objects at a time.
SLICE = 1 << 20


def _opening(label: str | None) -> str:
    """The tag that opens an entity's span."""
    return f'<span class="entity" style="background-color: {COLOURS.get(label, OTHER)}" title="{label or ""}">'


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows with about `size` bytes of text each, one row at least."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, stop - at
        at = stop


def _lists(column: pa.ListArray) -> list[list]:
    """The lists of a column, from all its elements at once; null is empty."""
    values = column.flatten().to_pylist()
    ends = np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905  one start more


@F.arrow_udf(StringType())
def _marked(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    # A batch has as many rows as the session says, of any length; as Python objects they would take many times their size.
    for columns in parts:
        if not len(columns[0]):
            yield pa.array([], pa.string())
        for at, n in slices(columns[0], SLICE):
            texts, entities, labels = (c.slice(at, n) for c in columns)
            tags = {x: _opening(x) for x in labels.flatten().unique().to_pylist()}
            rows = zip(texts.to_pylist(), _lists(entities), _lists(labels), strict=True)
            yield pa.array([marking.marked(t, e, [tags[x] for x in own]) if e else t for t, e, own in rows], pa.string())


def highlight(text: Column, entities: Column) -> Column:
    """The escaped text with a span around each whole-word occurrence of each entity, longest entities first.

    Entity texts are taken as they are, so one with a character that HTML escapes is not found; short entities
    are found inside the spans of longer ones. One pass over the text, however many entities there are.
    """
    ranked = longest_first(entities)
    return _marked(html_escape(F.coalesce(text, F.lit(""))), F.transform(ranked, lambda e: F.coalesce(e["text"], F.lit(""))), F.transform(ranked, lambda e: e["label"]))


def summary(entities: DataFrame) -> DataFrame:
    """base, label, rank (of first sight), n (with repeats), items (distinct, sorted) of each document."""
    g = entities.groupBy("base", "label").agg(F.min("entity_idx").alias("first"), F.count("*").alias("n"), F.sort_array(F.collect_set("text")).alias("items"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy("first")))


STYLE = "nav{position:fixed;width:220px}nav a{display:block}main{margin-left:240px}pre{white-space:pre-wrap}.entity{padding:2px;border-radius:3px}"


def sections(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """base, html: a section for each document with its highlighted text and summary; the original file's name where docs has file_name."""
    listed = entities.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("entity_idx", "text", "label"))).alias("entities"))
    shade = F.concat(F.lit('<span class="entity" style="background-color: '), colour(F.col("label")), F.lit('">'))
    items = F.array_join(F.transform("items", lambda x: F.concat(shade, html_escape(x), F.lit("</span>"))), "\n")
    one = F.concat(F.lit("<h4>"), html_escape(F.col("label")), F.lit(" ("), F.col("n").cast("string"), F.lit(")</h4><div>"), items, F.lit("</div>"))
    sums = summary(entities).withColumn("one", one).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("rank", "one"))).alias("sums"))
    df = docs.join(listed, "base", "left").join(sums, "base", "left")
    name = F.concat(F.lit("<p><strong>Original file:</strong> "), html_escape(F.col("file_name")), F.lit("</p>")) if "file_name" in docs.columns else F.lit("")
    count = F.concat(F.lit("<p><strong>Entities found:</strong> "), F.coalesce(F.size("entities"), F.lit(0)).cast("string"), F.lit("</p>"))
    body = F.concat(
        F.lit('<section id="'), html_escape(F.col("base")), F.lit('"><h2>'), html_escape(F.col("base")), F.lit("</h2>"), name, count,
        F.lit("<pre>"), highlight(F.col("text"), F.coalesce("entities", no_entities())), F.lit("</pre>"),
        F.coalesce(F.array_join(F.transform("sums", lambda s: s["one"]), ""), F.lit("")), F.lit("</section>"),
    )
    return df.select("base", body.alias("html"))


def _head() -> str:
    legend = "".join(f'<span style="background-color: {c}">{n}</span>' for n, c in COLOURS.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Entities</title><style>{STYLE}</style></head><body><div>{legend}</div>"


def pages(parts: DataFrame) -> DataFrame:
    """base, html: each section as a page of its own; the form for many documents, which no task gathers."""
    return parts.select("base", F.concat(F.lit(_head() + "<main>"), "html", F.lit("</main></body></html>")).alias("html"))


def page(parts: DataFrame, bases: DataFrame) -> DataFrame:
    """html: the whole report as one row. The sidebar lists all bases, also those without a section.

    In one row, so for a bounded set; pieces() makes the same page as a file of any size, and pages() a page for each document.
    """
    ordered = lambda df, c: df.agg(F.array_sort(F.collect_list(F.struct("base", c.alias("x")))).alias("a")).select(F.array_join(F.transform("a", lambda e: e["x"]), "\n").alias("x"))
    base = html_escape(F.col("base"))
    side = ordered(bases.select("base").distinct(), F.concat(F.lit('<a href="#'), base, F.lit('">'), base, F.lit("</a>"))).withColumnRenamed("x", "side")
    body = F.concat(F.lit(_head() + "<nav>"), "side", F.lit("</nav><main>"), "x", F.lit("</main></body></html>"))
    return ordered(parts, F.col("html")).join(side, F.lit(True)).select(body.alias("html"))


def pieces(parts: DataFrame, bases: DataFrame) -> DataFrame:
    """place, base, piece: what page() consists of, in order; sources.sinks.write_pieces() makes one file of them. The file ends with a line feed."""
    base = html_escape(F.col("base"))
    spark = parts.sparkSession
    fixed = spark.createDataFrame([(0, "", _head() + "<nav>"), (2, "", "</nav><main>"), (4, "", "</main></body></html>\n")], "place int, base string, piece string")

    def listed(df: DataFrame, place: int, text: Column) -> DataFrame:
        """Texts by base, each but the first behind a line feed."""
        first = df.agg(F.min("base").alias("_least"))  # one row
        numbered = df.join(F.broadcast(first), F.lit(True))
        return numbered.select(F.lit(place).alias("place"), "base", F.concat(F.when(F.col("base") == F.col("_least"), "").otherwise("\n"), text).alias("piece"))

    side = listed(bases.select("base").distinct(), 1, F.concat(F.lit('<a href="#'), base, F.lit('">'), base, F.lit("</a>")))
    return fixed.unionByName(side).unionByName(listed(parts, 3, F.col("html")))
