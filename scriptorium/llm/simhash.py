"""SimHash near-dedup with pivot distance tables.

Pivots are reference fingerprints; a fingerprint's coordinates are its Hamming distances to them. By the triangle
inequality, the coordinates of two fingerprints within two bits differ by at most two each. That is used three times:
to route (each of the first few coordinates is cut into cells, and a fingerprint within two of the next cell is filed
there too, so close fingerprints share all cells of a key), to scan (members of a key are sorted by the next
coordinate, and each meets those within two of it only), and to discard (pairs of which any coordinate differs by
more than two). Survivors are verified by the Hamming distance itself. Cells alone would be too coarse for billions of
fingerprints, so a key also holds one of three blocks of bits: two differing bits leave one block as it is. A key
with more than CROWD members is filed again by cells of further pivots; what is still crowded when all pivots are
used up is linked through the fingerprints one bit away, by a join, which is exact too and linear. Only a spanning
forest of links leaves a key, never all pairs. Components come from large-star and small-star rounds.

Cases: texts without words, null ones too, have fingerprint zero; repeated rows share it; the component id is the
least id that is not null, null if a group has none; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, materialise, row_key, small_batches, text_of, without_rows

SEED, RADIUS, SHINGLE = 42, 2, 3
#: Pivots, pivots whose cells route at a time, and the width of a cell; coordinates cluster around 32, a border.
PIVOTS, ROUTE, CELL = 24, 6, 16
#: Members of a key from which it is filed again, and rows of drops that are broadcast.
CROWD, DROPS = 4_000, 2_000_000
#: Blocks as (lowest bit, bits).
BLOCKS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes) -> int:
    """SimHash of a text's words of three."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) >= SHINGLE else iter([b" ".join(w)])
    n = max(1, len(w) - SHINGLE + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = h[at : at + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row's content), fp of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t or b"") for t in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "key", "fp"])

    return docs.select("doc_id", row_key().alias("key"), text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, key long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, from a rule."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], np.uint64)


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def coordinates(fp: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The pivot distance table: a row for each fingerprint, a column for each pivot."""
    return np.bitwise_count(fp.view(np.uint64)[:, None] ^ reference[None, :]).view(np.int8)


def cells(fp: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Member number and cell code of each fingerprint, once for each combination of cells within RADIUS above its coordinates.

    Of two coordinates that differ by at most RADIUS, the upper one's cell is the lower one's or the cell RADIUS above it.
    """
    table = coordinates(fp, reference)
    who, code = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    for p in range(len(reference)):
        here, next_ = table[who, p] // CELL, (table[who, p] + RADIUS) // CELL
        both = here != next_
        who, code = np.r_[who, who[both]], np.r_[code * 8 + here, code[both] * 8 + next_[both]]
    return who, code


def routed(filed: DataFrame, level: int) -> DataFrame:
    """key, fp: members under the cells of this level's pivots. Level 0 takes fp and adds the blocks of bits; others take key, fp and refine keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = pivots()[level * ROUTE : (level + 1) * ROUTE]
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                fp = part.column(part.num_columns - 1).to_numpy()
                who, code = cells(fp, reference)
                if level:
                    made = [mixed(part.column(0).to_numpy()[who].view(np.uint64) ^ mixed(code.view(np.uint64) + np.uint64(level)))]
                else:
                    bits = [(fp.view(np.uint64) >> np.uint64(low) & np.uint64((1 << n) - 1))[who] for low, n in BLOCKS]
                    made = [np.uint64(b << 60) | x << np.uint64(3 * ROUTE) | code.view(np.uint64) for b, x in enumerate(bits)]
                for key in made:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[who])], ["key", "fp"])

    return filed.mapInArrow(run, "key long, fp long")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def links(key: np.ndarray, fp: np.ndarray, reference: np.ndarray, tally: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among members of each key; rows come sorted by key and the first pivot's coordinate, whole keys only.

    tally: counts pairs under a key, in a scan, left by the pivots, and linked.
    """
    n = len(key)
    table = coordinates(fp, reference)
    fp = fp.view(np.uint64)
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]]) if n else np.zeros(0, int)
    order = group * 256 + table[:, 0]
    left = np.searchsorted(order, order + RADIUS, "right") - np.arange(n)  # members from this one to the last within RADIUS
    if tally is not None:
        size = np.bincount(group)
        tally["met"] += int((size * (size - 1) // 2).sum())
        tally["scanned"] += int((left - 1).sum())
    forest, at, step = Forest(n), np.arange(n), 1
    while len(at := at[left[at] > step]):
        close = at[np.abs(table[at] - table[at + step]).max(axis=1) <= RADIUS]
        linked = close[np.bitwise_count(fp[close] ^ fp[close + step]) <= RADIUS]
        for i in linked.tolist():
            forest.join(i, i + step)
        if tally is not None:
            tally["left"] += len(close)
            tally["linked"] += len(linked)
        step += 1
    root = np.fromiter(map(forest.root, range(n)), np.int64, n)
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved].view(np.int64), fp[root[moved]].view(np.int64)


def linked(filed: DataFrame, level: int) -> DataFrame:
    """a, b: links within each key. Members are scanned by the first coordinate that did not route."""
    first = min((level + 1) * ROUTE, PIVOTS - 1)
    reference = np.r_[pivots()[first:], pivots()[:first]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in links(key, fp, reference)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
            if count >= 100_000 and held[-1][0].size and held[-1][0][-1] != held[0][0][0]:
                key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                yield out(key[:cut], fp[:cut])
                held, count = [(key[cut:], fp[cut:])], len(key) - cut
        if count:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    coordinate = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(reference[:1].view(np.int64)[0]))))
    return filed.repartition("key").sortWithinPartitions("key", coordinate, "fp").mapInArrow(run, "a long, b long")


def neighbours(fps: DataFrame) -> DataFrame:
    """a, b: links between fingerprints that share one of their 65 neighbours within one bit, by a join on these."""
    near = F.array("fp", *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0))) for b in range(64)])
    met = fps.select(F.explode(near).alias("near"), "fp").groupBy("near").agg(F.collect_set("fp").alias("fps"))  # 65 at most
    return met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a != b")


def edges(fps: DataFrame) -> DataFrame:
    """a, b: links that join all fingerprints that reach each other."""
    filed, found = routed(fps, 0), []
    for level in range(PIVOTS // ROUTE):
        filed = materialise(filed, "simhash-keys")
        crowded = materialise(filed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("key"), "simhash-crowded")
        many = crowded.count()
        if not many:
            found.append(linked(filed, level))
            break
        crowded = broadcast_if(crowded, many <= DROPS)
        found.append(linked(filed.join(crowded, "key", "left_anti"), level))
        filed = filed.join(crowded, "key", "left_semi")
        if level + 1 < PIVOTS // ROUTE:
            filed = routed(filed, level + 1)
        else:
            found.append(neighbours(filed.select("fp").distinct()))
    return reduce(DataFrame.union, found).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each linked node reaches. Alternating stars, written after each round."""
    seen = None
    now = materialise(links, "simhash-links")
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        stars = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a != b").distinct()
        before, now = now, materialise(stars, "simhash-stars")
        discard(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.toDF("node", "root")
        seen = mark


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp, root (a fingerprint), component_id of every document."""
    prints = materialise(fingerprints(docs), "simhash-fps")
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(edges(fps.select("fp")))
    known = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = materialise(known, "simhash-known")
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(known.select("fp", "root").join(ids, "root"), "fp")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: the contract's rows."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each component, whole rows: the least id (null last), then the least key.

    Of rows that repeat id and text one stays.
    """
    known = materialise(classes(docs).select("doc_id", "key", "root"), "simhash-classes")
    stay = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    stay = materialise(stay, "simhash-stay")  # a join of two plain exchanges, whose hot partitions adaptive execution splits
    gone = known.join(stay, "root").filter("NOT (doc_id <=> first.doc_id AND key = first.key)").select("doc_id", "key").distinct()
    return without_rows(docs, gone, DROPS)
