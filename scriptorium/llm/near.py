"""Near-dedup of texts: SimHash classes and MinHash bands, pivot distance tables, exact verification by Jaccard similarity.

Texts are near copies if the sets of their lower-case words of five have a Jaccard similarity of at least 0.8, and
groups are what such pairs reach. Texts meet in two ways. SimHash: a class of fingerprints linked at two bits or fewer
(simhash.classes, the method of op5) is a bucket. Many near copies differ in more bits, up to 11 and more, and keys for
that radius have some ten bits, so that their groups grow with the square of the input; so texts also meet by MinHash.

Texts that agree on a band of five minima meet in a bucket: with 20 bands, a pair at 0.8 meets with probability
0.9996, closer ones surely for all practical purposes. Buckets of bands of the same members count once. In a bucket, a table
of Jaccard distances to a few pivots discards pairs of which any coordinate differs by more than 0.2 (the triangle
inequality), and the others are verified on their whole sets, unless links already join them. Only a spanning forest
of links leaves a bucket. A bucket of more than CROWD members is dealt out by hash into parts, each with the same
few leaders of the bucket, so that the parts of a group hold together. Leaders are the members that stand in most
crowded buckets, as the text that others were made from does, one of each hash class. Then all links are followed, and
in each crowded bucket the rest, the members outside its largest group, meets all members in blocks of both. So no
pair of a bucket is left out: it was in one part, or is in one group by then, or one of the two is of the rest.

Cases: a text of one to four words is one shingle; texts without words, null ones too, are all alike; of rows that
repeat id and text one stays; of a group the least doc_id stays (null last); an empty table gives no rows; further
columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, materialise, row_key, small_batches, text_of, without_rows
from .simhash import DROPS, SEED, Forest, classes, components

SHINGLE, SHARE = 5, 0.8
BANDS, ROWS = 20, 5
PIVOTS = 8
#: Members of a bucket from which it is dealt out, leaders that its parts share, words remembered by a worker.
CROWD, LEADERS, MEMO = 250, 8, 200_000
_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, SHINGLE + BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes(dict):
    """Hashes of words, bounded in entries."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def shingles(text: str, hashes: Hashes) -> np.ndarray:
    """Distinct hashes of a text's words of five, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(w))):
        h += (w[i : i + n] ^ (w[i : i + n] >> np.uint64(31))) * _ODD[i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band, of ROWS minima."""
    odd, least = _ODD[SHINGLE:], np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1000):
        np.minimum(least, (s[at : at + 1000, None] * odd[None, :]).min(axis=0), out=least)
    least = (least ^ (least >> np.uint64(33))) * odd
    keys = np.bitwise_xor.reduce((least ^ (least >> np.uint64(31))).reshape(BANDS, ROWS), axis=1)
    return (keys ^ np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of ascending numbers."""
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def links(sets: list[np.ndarray], groups: list[int]) -> list[tuple[int, int]]:
    """Spanning links between members of which a chain of pairs at SHARE or more joins. Members of equal groups are joined already."""
    n, found = len(sets), []
    forest, size = Forest(n), np.array([len(s) for s in sets])
    first: dict[int, int] = {}
    for i, group in enumerate(groups):
        forest.join(first.setdefault(group, i), i)

    def join(i: int, j: int) -> None:
        if forest.root(i) != forest.root(j):
            forest.join(i, j)
            found.append((i, j))

    table, at = np.zeros((n, min(PIVOTS, n))), 0
    for p in range(table.shape[1]):
        for i in range(n):
            table[i, p] = 1 - jaccard(sets[i], sets[at])
            if table[i, p] <= 1 - SHARE + 1e-9:
                join(i, at)
        at = int(table[:, : p + 1].min(axis=1).argmax())  # the next pivot is the member that is farthest from all
        if table[at, : p + 1].min() == 0:
            table = table[:, : p + 1]
            break
    for step in range(1, n):
        root = np.fromiter(map(forest.root, range(n)), np.int64, n)
        if not root.any():
            break
        a, b = size[:-step], size[step:]
        may = (root[:-step] != root[step:]) & (np.minimum(a, b) >= SHARE * np.maximum(a, b) - 1e-9)
        may[may] = np.abs(table[:-step][may] - table[step:][may]).max(axis=1) <= 1 - SHARE + 1e-9
        for i in np.flatnonzero(may).tolist():
            if forest.root(i) != forest.root(i + step) and jaccard(sets[i], sets[i + step]) >= SHARE - 1e-9:
                join(i, i + step)
    return found


def by_simhash(docs: DataFrame) -> DataFrame:
    """bucket, n, rid: the members of each class of fingerprints that has two or more."""
    known = materialise(classes(docs).select("key", "root").distinct(), "near-simhash")
    many = materialise(known.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1"), "near-classes")
    met = known.join(broadcast_if(many, many.count() <= DROPS), "root")
    return met.select(F.xxhash64(F.lit("simhash"), "root").alias("bucket"), "n", F.col("key").alias("rid"))


def buckets(docs: DataFrame) -> DataFrame:
    """bucket, n (about its members), rid: members that meet, without buckets of one and those whose members meet elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in small_batches(batches):
            keys = [bands(shingles(t or "", hashes)) for t in batch.column(1).to_pylist()]
            if keys:
                rid = np.repeat(batch.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(rid)], ["bucket", "rid"])

    filed = materialise(docs.select(row_key().alias("rid"), "text").mapInArrow(run, "bucket long, rid long"), "near-bands")
    mark = F.xxhash64("rid").cast("decimal(38,0)")
    met = filed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(mark).alias("mark"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo < hi")
    met = materialise(met.groupBy("n", "mark", "lo", "hi").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "near-buckets")
    met = broadcast_if(met, met.count() <= DROPS)
    members = filed.join(met, "bucket").select("bucket", "n", "rid").distinct()
    members = materialise(members.union(by_simhash(docs)), "near-members")
    discard(filed)
    return members


def dealt(members: DataFrame) -> DataFrame:
    """bucket, part, rid, group (the row itself): buckets as they are, crowded ones in parts with leaders."""
    parts = F.ceil(F.col("n") / CROWD)
    plain = members.select("bucket", F.pmod(F.xxhash64("bucket", "rid"), parts).alias("part"), "rid")
    crowd = members.filter(F.col("n") > CROWD)
    fame = crowd.groupBy("rid").agg(F.count("*").alias("fame"))
    kind = F.pmod(F.xxhash64("rid", "bucket"), F.lit(LEADERS))
    first = F.array_compact(F.array(*[F.min(F.when(kind == i, F.struct(-F.col("fame"), "rid")))["rid"] for i in range(LEADERS)]))
    led = crowd.join(fame, "rid").groupBy("bucket", "n").agg(first.alias("l"))
    led = led.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "l").select("bucket", "part", F.explode("l").alias("rid"))
    return plain.union(led).distinct().withColumn("group", F.col("rid"))


def rest(members: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, part, rid, group: of each crowded bucket, blocks of the members outside its largest group with blocks of all."""
    known = members.filter(F.col("n") > CROWD).join(roots, F.col("rid") == F.col("node"), "left").select("bucket", "rid", F.coalesce("root", "rid").alias("group"))
    known = materialise(known, "near-crowds")
    sizes = known.groupBy("bucket", "group").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("all"), F.max(F.struct("k", "group")).alias("most"))
    sizes = sizes.select("bucket", F.col("most.group").alias("main"), F.ceil(F.col("all") / CROWD).alias("wide"), F.ceil((F.col("all") - F.col("most.k")) / CROWD).alias("high"))
    sizes = materialise(sizes.filter("high > 0"), "near-rests")
    known = known.join(broadcast_if(sizes, sizes.count() <= DROPS), "bucket")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = "bucket", (F.col("row") * F.col("wide") + F.col("column")).alias("part"), "rid", "group"
    rows = known.filter("group != main").withColumn("row", F.pmod(F.xxhash64("rid", "bucket"), "high")).withColumn("column", upto("wide"))
    every = known.withColumn("column", F.pmod(F.xxhash64("bucket", "rid"), "wide")).withColumn("row", upto("high"))
    return rows.select(*columns).union(every.select(*columns)).distinct()


def verified(docs: DataFrame, filed: DataFrame) -> DataFrame:
    """a, b: verified links between rows (by row_key) of a part that join its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, rids, groups, sets = Hashes(), None, [], [], []

        def out() -> pa.RecordBatch:
            found = links(sets, groups)
            return pa.RecordBatch.from_arrays([pa.array([rids[x[i]] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in small_batches(batches):
            for bucket, part, rid, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, part) != now:
                    if len(sets) > 1:
                        yield out()
                    now, rids, groups, sets = (bucket, part), [], [], []
                if not rids or rids[-1] != rid:  # rows that repeat id and text
                    rids.append(rid)
                    groups.append(group)
                    sets.append(shingles(text or "", hashes))
        if len(sets) > 1:
            yield out()

    parts = materialise(filed, "near-parts")
    texts = docs.select(row_key().alias("rid"), text_of().alias("text")).join(broadcast_if(parts, parts.count() <= DROPS // 4), "rid").select("bucket", "part", "rid", "group", "text")
    found = texts.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "rid").mapInArrow(run, "a long, b long").distinct()
    found = materialise(found, "near-links")
    discard(parts)
    return found


def edges(docs: DataFrame) -> DataFrame:
    """a, b: verified links between rows (by row_key) that join every group."""
    members = buckets(docs)
    found = verified(docs, dealt(members))
    if not members.filter(F.col("n") > CROWD).isEmpty():
        found = found.union(verified(docs, rest(members, components(found))))
    discard(members)
    return found


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, whole rows: the least id (null last), then the least key."""
    roots = components(edges(docs))
    roots = roots.union(roots.select("root", "root")).distinct()
    few = broadcast_if(roots, roots.count() <= DROPS)
    known = docs.select("doc_id", row_key().alias("node")).join(few, "node").select("doc_id", F.col("node").alias("key"), "root")
    known = materialise(known, "near-known")
    stay = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    gone = known.join(stay, "root").filter("key != first.key").select("doc_id", "key").distinct()
    return without_rows(docs, gone, DROPS)
