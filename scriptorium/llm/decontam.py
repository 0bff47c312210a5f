r"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions.

Texts become lower-case words ``[\p{L}\p{N}]+`` and shingles of five. An item is contained in a document if at
least 0.8 of its distinct shingles stand there. Items are partitioned by size, and each size class has a share: the
signature of an item is its shingles whose hash is among that lowest share of all hashes (a MinHash sketch by
threshold); small items keep all of theirs, large ones a quarter. A document that holds 0.8 of an item of n shingles
lacks at most floor(0.2 n) of them, so of a signature of s it has s - floor(0.2 n) or more: that is each item's own
candidate threshold, and no containment is missed. An item whose signature would be too small for a threshold of one
keeps all its shingles. Documents are not sketched, since a short item would be lost in them; each of their shingles
is looked up among the signatures. The pairs found are verified by exact containment of shingle texts.

Signatures, and the shingles to verify, are broadcast in blocks of some ITEM_BYTES, dealt by shingle and item so that
no item is too large for a block. Each block is a pass over the documents and a job of its own that appends its hits to
one table, so one block is broadcast at a time and no plan grows with the items; counts add up over blocks.

Cases: items of fewer than five words have no shingle and match nothing; null texts are empty and contain nothing;
repeated items of one id are one item (the union of their shingles); repeated documents give one row; a null
doc_id or item_id is an id like any other; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, in_turn, materialise, row_key, text_of

WIDTH, SHARE = 5, 0.8
#: Size classes: most shingles of an item, and the share of the hash range that signs it; larger items have LARGE.
CLASSES, LARGE = ((16, 1.0), (64, 0.6), (256, 0.4), (1024, 0.3)), 0.25
#: Bounds of what is broadcast: bytes of item shingles (48 for a row's numbers), and found pairs.
ITEM_BYTES, PAIRS = 64 << 20, 2_000_000


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, words and each place where a shingle starts."""
    df = df.select(*keep, words(text_of()).alias("_w"))
    places = F.when(F.size("_w") >= WIDTH, F.sequence(F.lit(0), F.size("_w") - WIDTH))  # no filter and no plain explode, which would split texts twice
    return df.select(*keep, "_w", F.explode_outer(places).alias("_at")).filter("_at IS NOT NULL")


def _at(i: int) -> Column:
    return F.get("_w", F.col("_at") + i)


def shingle_hash() -> Column:
    """Hash of the shingle at `_at`."""
    return F.xxhash64(*[_at(i) for i in range(WIDTH)])


def shingle() -> Column:
    """The shingle at `_at`."""
    return F.concat_ws(" ", *[_at(i) for i in range(WIDTH)])


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, shingle, h, n (of the item), need (signature shingles that a candidate shares), signed, block."""
    own = exploded(items.select("item_id", "text"), "item_id").select("item_id", shingle().alias("shingle"), shingle_hash().alias("h")).distinct()
    place = F.shiftrightunsigned("h", 32)  # 32 bits of the hash
    shares = sorted({LARGE, *(s for _, s in CLASSES)})
    low = {s: place < int(s * (1 << 32)) for s in shares}
    sizes = own.groupBy("item_id").agg(F.count("*").cast("int").alias("n"), *[F.count_if(low[s]).alias(f"_s{i}") for i, s in enumerate(shares)])
    mine = lambda of: reduce(lambda rest, c: F.when(F.col("n") <= c[0], of(c[1])).otherwise(rest), reversed(CLASSES), of(LARGE))
    spare = F.floor(F.col("n") * (1 - SHARE) + 1e-9)
    signed = mine(lambda s: F.col(f"_s{shares.index(s)}"))
    sizes = sizes.withColumn("_all", signed <= spare).withColumn("need", F.when(F.col("_all"), F.col("n")).otherwise(signed) - spare)
    sizes = sizes.select(F.col("item_id").alias("_i"), "n", "need", "_all")
    known = own.join(sizes, own.item_id.eqNullSafe(sizes._i)).drop("_i")
    return known.select("item_id", "n", "need", "h", "shingle", (F.col("_all") | mine(lambda s: low[s])).alias("signed"))


def dealt(known: DataFrame, size: Column) -> list[DataFrame]:
    """Parts of item shingles of about ITEM_BYTES each; `size`: bytes of a row."""
    blocks = max(1, -(-(known.agg(F.sum(size)).first()[0] or 0) // ITEM_BYTES))
    return [known] if blocks == 1 else [known.filter(F.pmod(F.xxhash64("item_id", "h"), F.lit(blocks)) == b) for b in range(blocks)]


def candidates(docs: DataFrame, signatures: list[DataFrame]) -> DataFrame:
    """doc_id, key, item_id: pairs that share as many signature shingles as the item needs."""
    places = exploded(docs.select("doc_id", "text", row_key().alias("key")), "doc_id", "key").select("doc_id", "key", shingle_hash().alias("_h"))
    hits = in_turn(signatures, lambda s: places.join(F.broadcast(s.select(F.col("h").alias("_h"), "item_id", "need")), "_h"), "decontam-hits")
    shared = hits.groupBy("doc_id", "key", "item_id", "need").agg(F.countDistinct("_h").alias("n"))
    return shared.filter(F.col("n") >= F.col("need")).select("doc_id", "key", "item_id")


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, key, item_id, n_shared, n_shingles, containment of every contained item."""
    known = materialise(item_shingles(items), "decontam-items")
    pairs = materialise(candidates(docs, dealt(known.filter("signed"), F.lit(48))), "decontam-pairs")
    few = pairs.count() <= PAIRS
    some = broadcast_if(pairs.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct(), few)
    held = docs.select("doc_id", "text", row_key().alias("key"))
    held = held.join(some, held.doc_id.eqNullSafe(some._d) & (held.key == some._k), "left_semi")
    places = exploded(held, "doc_id", "key").withColumn("_h", shingle_hash())

    def met(part: DataFrame) -> DataFrame:
        part = F.broadcast(part.select("item_id", "n", F.col("h").alias("_h"), "shingle"))
        return places.join(part, "_h").filter(shingle() == F.col("shingle")).select("doc_id", "key", "item_id", "n", "shingle")

    hits = in_turn(dealt(known, F.octet_length("shingle") + 48), met, "decontam-held")
    shared = hits.groupBy("doc_id", "key", "item_id", "n").agg(F.countDistinct("shingle").alias("n_shared"))
    a, b = shared.alias("a"), broadcast_if(pairs, few).alias("b")
    same = F.expr("a.key = b.key AND a.doc_id <=> b.doc_id AND a.item_id <=> b.item_id")
    return a.join(b, same, "left_semi").filter(F.col("n_shared") >= SHARE * F.col("n") - 1e-9).select(
        "doc_id", "key", "item_id", "n_shared", F.col("n").cast("long").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment")
    )


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item it contains."""
    return contained(docs, items).drop("key").distinct()


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, whole rows."""
    gone = materialise(contained(docs, items).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "decontam-gone")
    gone = broadcast_if(gone, gone.count() <= PAIRS)
    return docs.join(gone, docs.doc_id.eqNullSafe(gone._id) & (row_key() == gone._key), "left_anti")
