"""Exact dedup: two-pass Bloom filtering, so that only possibly repeated rows shuffle.

The first pass counts, for each bit of a blocked Bloom filter, how many rows set it; a bit is "repeated" at two or
more. The second pass probes every row: a row with any bit that only it sets has a text of its own and passes
straight through. The others meet on the SHA-256 of their normalised text. DataFrame functions only.

The filter has a block of 64 bits for every ROWS_PER_BLOCK rows at any size, so under 1 % of the rows with a text of
their own are taken for repeated. It is broadcast in pages of 64 blocks. Filters of more than SLICE blocks are dealt
in slices: the rows are written once, by slice, and one job for each slice probes it with its own part of the filter and
appends the result to one table, so what is broadcast at a time has a bound and no plan grows with the number of slices.

Cases: null and blank texts are all equal to the empty text; ties of length go to the smallest doc_id (null first),
then to the least hash of the original text; of rows that repeat both id and text one is kept; an empty table gives
an empty result; extra columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_turn, materialise, new_path, text_of

BLANKS = "[\\x20\\x09-\\x0D]+"
#: Bits that a row sets, one in each lane of 16 bits; rows for a block; blocks of a page; blocks that are broadcast at once (128 MB).
PROBES, LANE, ROWS_PER_BLOCK, PAGE, SLICE = 4, 16, 4, 64, 1 << 24


def normal(text: Column) -> Column:
    """A text without its blanks."""
    return F.regexp_replace(text, BLANKS, "")


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text without its blanks."""
    return F.sha2(normal(text).cast("binary"), 256)


def n_blocks(rows: int) -> int:
    """Blocks of the filter for so many rows."""
    return max(1, -(-rows // ROWS_PER_BLOCK))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def with_probe(df: DataFrame, key: Column, blocks: int) -> DataFrame:
    """Adds a row's slice, page, block of the page, and the bits it sets there."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("_g", F.xxhash64(key, F.lit(1)))
    bits = [(F.shiftrightunsigned("_g", LANE * i).bitwiseAND(F.lit(LANE - 1)) + LANE * i).cast("int") for i in range(PROBES)]
    at = F.col("_b")
    return df.withColumns({"_slice": F.floor(at / SLICE).cast("int"), "_page": F.floor(at / PAGE), "_at": (at % PAGE).cast("int"), "_bits": F.array(*bits)}).drop("_b", "_g")


def repeated_bits(probed: DataFrame) -> DataFrame:
    """Pass one: pages of the bits that two or more rows set. Hot texts collapse in the partial count."""
    keys = ["_slice", "_page", "_at"]
    per_bit = probed.select(*keys, F.explode_outer("_bits").alias("_bit")).groupBy(*keys, "_bit").agg(F.count("*").alias("n")).filter("n >= 2")
    blocks = per_bit.groupBy(*keys).agg(F.bit_or(_bit(F.col("_bit"))).alias("_seen"))
    pages = blocks.groupBy("_slice", "_page").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_seen"))).alias("_m"))  # at most PAGE entries
    return pages.select("_slice", "_page", F.transform(F.sequence(F.lit(0), F.lit(PAGE - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0).cast("long"))).alias("_seen"))


def flagged(probed: DataFrame, bloom: DataFrame) -> DataFrame:
    """Pass two over one slice: the rows and _maybe, whether they may be repeated. The filter has at most SLICE blocks."""
    mask = reduce(Column.bitwiseOR, [_bit(F.get("_bits", F.lit(i))) for i in range(PROBES)])
    flag = F.coalesce(F.get("_seen", F.col("_at")).bitwiseAND(mask) == mask, F.lit(False))
    return probed.join(F.broadcast(bloom.drop("_slice")), "_page", "left").withColumn("_maybe", flag).drop("_slice", "_page", "_at", "_bits", "_seen")


def sieve(probed: DataFrame, digests: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both passes: rows that may be repeated, and unique rows. `digests` holds the probes of all rows for the first pass."""
    bloom = materialise(repeated_bits(digests), "exact-bloom")
    slices = -(-blocks // SLICE)
    dealt = probed
    if slices > 1:
        path = new_path(probed.sparkSession, "exact-slices")
        probed.write.partitionBy("_slice").parquet(path)  # no shuffle: each task writes its rows by slice
        dealt = probed.sparkSession.read.schema(probed.schema).parquet(path).select(probed.columns)
    one = (lambda s: flagged(dealt.filter(F.col("_slice") == s), bloom.filter(F.col("_slice") == s))) if slices > 1 else (lambda _: flagged(dealt, bloom))
    rows = in_turn(list(range(slices)), one, "exact-flagged")
    return rows.filter("_maybe").drop("_maybe"), rows.filter("NOT _maybe").drop("_maybe")


def groups(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    small = materialise(
        docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.length(text_of()).alias("_n"), digest(text_of()).alias("text_sha256")), "exact-digests"
    )
    blocks = n_blocks(small.count())
    probed = with_probe(small, F.col("text_sha256"), blocks)
    maybe, unique = sieve(probed, probed, blocks)
    best = maybe.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("_n")).alias("n"), "doc_id", "_row")).alias("best"))
    best = materialise(best, "exact-groups")  # a join of two plain exchanges, whose hot partitions adaptive execution splits
    met = maybe.join(best, "text_sha256").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best._row") == F.col("_row")).alias("kept"), "text_sha256")
    return met.unionByName(unique.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, whole rows; unique texts never shuffle, copies collapse before they do.

    The filter works on a 64-bit hash of the normalised text; SHA-256 is taken of rows that may be repeated only.
    """
    hashes = materialise(docs.select(F.xxhash64(normal(text_of())).alias("_h")), "exact-hashes")
    blocks = n_blocks(hashes.count())
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", F.xxhash64(normal(text_of())).alias("_h"))
    maybe, unique = sieve(with_probe(named, F.col("_h"), blocks), with_probe(hashes, F.col("_h"), blocks), blocks)
    order = F.struct((-F.length(text_of())).alias("n"), "doc_id", F.xxhash64("text").alias("t"))
    stay = maybe.groupBy(digest(text_of()).alias("_sha")).agg(F.min_by("_row", order).alias("_row"))
    return stay.select("_row.*").unionByName(unique.select("_row.*"))
