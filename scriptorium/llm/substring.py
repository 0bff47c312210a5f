"""Substring dedup: words in windows that repeat anywhere go, found with suffix automata of reference shards.

Every window of 35 words is filed under its anchor, the least hash among its word 8-grams, so equal windows share
an anchor wherever they stand. Neighbouring windows with one anchor form a region. Anchors that stand once cannot
repeat and are gone after one count. The regions of the others, each kind once with its number of places, are the
reference: every repeated window is settled by a suffix automaton of a shard of it, through which regions stream; a
window repeats if its matching statistics say that 35 words match and stand at two places or more.

The automata of the most frequent anchors are broadcast: as many anchors, by their number of places, as have BROADCAST
words of regions together. Regions stream past them where they are, without a shuffle, and an anchor's automaton counts
the places of all its regions. The rest, rarer and without a bound in number, cannot be broadcast, and not every document
can meet every shard: such anchors share shards of SHARD words, whose automata are built in tasks that get their regions
by shuffle. An anchor with more than SHARD words of its own is hot: its most frequent region is its reference, broadcast
(REFERENCE rows at most, else joined), and all its regions stream past that wherever they are, so no task gathers a hot
anchor. Windows that match it repeat; the few that do not are counted under their own hashes, over all tasks, as is the
reference itself.

Cases: null and short texts lose nothing; windows may overlap themselves; repeated rows are two places, so all
their windows repeat; a null doc_id is an id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, materialise, row_key, text_of

WINDOW, GRAM = 35, 8
#: Words of a shard, and of an anchor's regions that are no more one shard's; references that are broadcast (some 25 MB); automata and entries that a task remembers.
SHARD, REFERENCE, AUTOMATA, MEMO = 8_000, 50_000, 500, 500_000
#: Words of regions whose automata are broadcast (8 bytes each; a task builds those that it meets), and that a task keeps built (some 600 bytes each); documents with ranges whose keys are broadcast.
BROADCAST, HELD, KEYS = 2_000_000, 60_000, 500_000
_BASE = 0x9E3779B97F4A7C15
_KEY = "doc_id long, key long"


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            most = max(n, 2 * len(self.up))
            many = lambda x: np.multiply.accumulate(np.r_[np.uint64(1), np.full(most - 1, x, np.uint64)])
            self.up, self.down = many(_BASE), many(pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit number for each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Hashes:
    """Hashes of spans of one word sequence."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = _powers.get(len(words) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(words * self.up[:-1], dtype=np.uint64)]

    def spans(self, start, end) -> np.ndarray:
        """Hash of words start..end-1 each."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def regions(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """anchor, region hash, first window, number of windows of each region of a text."""
    n = len(words) - window + 1
    if n < 1:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    h, gram = Hashes(words), min(GRAM, window)
    at = np.arange(len(words) - gram + 1)
    grams = h.spans(at, at + gram)
    place = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    many = np.diff(np.r_[first, n])
    return grams[place[first]], h.spans(first, first + many + window - 1) ^ many.astype(np.uint64), first, many


class Automaton:
    """Suffix automaton of weighted sequences; counts occurrences of any substring."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, seq: list[int], weight: int) -> None:
        """Appends a sequence that counts `weight` times; it starts afresh at the root."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in seq:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
                count[last] += weight
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            count.append(weight)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        k = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        self.count.append(0)
        link.append(link[q])
        link[q] = k
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        return k

    def close(self) -> None:
        """Carries counts up the suffix links."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def matches(self, seq: list[int], most: int) -> Iterator[tuple[int, int]]:
        """For each position: the longest match that ends there, at most `most` long, and its count."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        s = n = 0
        for c in seq:
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s, n = nxt[s][c], n + 1
            if n > most:
                n = most
            while s and length[link[s]] >= n:
                s = link[s]
            yield n, count[s]


def repeated(seqs: list[np.ndarray], weights: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each region of one shard, whether each of its windows stands at two places or more."""
    auto, lists = Automaton(), [s.tolist() for s in seqs]
    for s, w in zip(lists, weights, strict=True):
        auto.add(s, w)
    auto.close()
    return [np.array([n == window and k >= 2 for n, k in auto.matches(s, window)][window - 1 :]) for s in lists]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """Smaller batches: Python objects of whole texts and ranges take many times their Arrow size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _filed(docs: DataFrame, window: int) -> DataFrame:
    """anchor, region, doc_id, key, at, many: the regions of every document."""
    schema = pa.schema([("anchor", pa.int64()), ("region", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("many", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = [regions(word_hashes((t or b"").split()), window) for t in part.column(2).to_pylist()]
            n = [len(x[0]) for x in found]
            anchor, region, at, many = (np.concatenate(x) for x in zip(*found, strict=True))
            who = pa.array(np.repeat(np.arange(part.num_rows), n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(region.view(np.int64)), part.column(0).take(who), part.column(1).take(who), pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32))], schema=schema
            )

    return docs.select("doc_id", row_key().alias("key"), text_of().cast("binary").alias("text")).mapInArrow(run, f"anchor long, region long, {_KEY}, at int, many int")


def _with_ranges(docs: DataFrame, ranges: DataFrame, others: bool) -> DataFrame:
    """doc_id, key, text, ranges: joined by row content, by shuffle. `others`: also documents without ranges.

    Texts without ranges stay where they are while the keys of the others are few; with more of them, most texts have ranges.
    """
    side = ranges.withColumnsRenamed({"doc_id": "_d", "key": "_k"}).hint("merge")
    d = docs.select("doc_id", row_key().alias("key"), text_of().cast("binary").alias("text"))
    same = lambda d, r: d.doc_id.eqNullSafe(r._d) & (d.key == r._k)
    if ranges.count() > KEYS:
        return d.join(side, same(d, side), "left" if others else "inner").select("doc_id", "key", "text", "ranges")
    keys = F.broadcast(ranges.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")))
    some = d.join(keys, same(d, keys), "left_semi")
    met = some.join(side, same(some, side)).select("doc_id", "key", "text", "ranges")
    if not others:
        return met
    rest = d.join(keys, same(d, keys), "left_anti").withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType))
    return met.unionByName(rest)


def _contents(docs: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """anchor, region, n, lead, way, words (as bytes) of each kind of region, read where it first stands. A kind can come more than once where rows repeat."""
    one = F.struct("anchor", "region", "n", "lead", "way", "first.at", "first.many")
    ranges = materialise(kinds.groupBy("first.doc_id", "first.key").agg(F.collect_list(one).alias("ranges")), "substring-firsts")
    schema = pa.schema([("anchor", pa.int64()), ("region", pa.int64()), ("n", pa.int64()), ("lead", pa.bool_()), ("way", pa.string()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in _slices([batch]):
                rows: list[tuple] = []
                for text, found in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = None
                    for r in found:
                        if (r["anchor"], r["region"]) not in seen:
                            seen.add((r["anchor"], r["region"]))
                            words = word_hashes((text or b"").split()) if words is None else words
                            rows.append((r["anchor"], r["region"], r["n"], r["lead"], r["way"], words[r["at"] : r["at"] + r["many"] + window - 1].tobytes()))
                if len(seen) > MEMO:
                    seen.clear()
                if rows:
                    yield _batch(list(zip(*rows, strict=True)), schema)

    return _with_ranges(docs, ranges, others=False).mapInArrow(run, "anchor long, region long, n long, lead boolean, way string, words binary")


_JUDGED = "anchor long, region long, first int, last int"


def _past_automata(contents: DataFrame, window: int) -> DataFrame:
    """_JUDGED: the repeated windows of frequent anchors, whose regions stream past broadcast automata."""
    spark = contents.sparkSession
    once = contents.groupBy("anchor", "region").agg(F.min("n").alias("n"), F.min("words").alias("words"))  # BROADCAST words at most
    shards: dict[int, list[tuple[int, bytes]]] = {}
    for r in once.collect():
        shards.setdefault(r.anchor, []).append((r.n, bytes(r.words)))
    sent = spark.sparkContext.broadcast(shards)
    schema = pa.schema([("anchor", pa.int64()), ("region", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata: dict[int, Automaton] = {}
        held = 0
        for batch in batches:
            rows: list[tuple] = []
            for anchor, region, data in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                auto = automata.get(anchor)
                if auto is None:
                    if held > HELD:
                        automata.clear()
                        held = 0
                    auto = automata[anchor] = Automaton()
                    for n, words in sent.value[anchor]:
                        held += len(words) // 8
                        auto.add(np.frombuffer(words, np.uint64).tolist(), n)
                    auto.close()
                flags = np.array([k == window and n >= 2 for k, n in auto.matches(np.frombuffer(data, np.uint64).tolist(), window)][window - 1 :])
                rows += [(anchor, region, i, j) for i, j in zip(*(x.tolist() for x in runs(flags)), strict=True)]
            if rows:
                yield _batch(list(zip(*rows, strict=True)), schema)

    return contents.select("anchor", "region", "words").mapInArrow(run, _JUDGED)


def _in_shards(contents: DataFrame, window: int) -> DataFrame:
    """_JUDGED: the repeated windows of anchors of at most SHARD words, by automata of shards of such anchors."""
    schema = pa.schema([("anchor", pa.int64()), ("region", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows: list[tuple] = []
            flags = repeated([np.frombuffer(w, np.uint64) for *_, w in shard], [n for _, _, n, _ in shard], window)
            for (a, r, _, _), f in zip(shard, flags, strict=True):
                rows += [(a, r, i, j) for i, j in zip(*(x.tolist() for x in runs(f)), strict=True)]
            return _batch(list(zip(*rows, strict=True)) or [[]] * 4, schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard and row[:2] == shard[-1][:2]:
                    continue
                more = len(row[3]) // 8
                if shard and row[0] != shard[-1][0] and size + more > SHARD:
                    yield out()
                    shard, size = [], 0
                shard.append(row)
                size += more
        if shard:
            yield out()

    return contents.select("anchor", "region", "n", "words").repartition("anchor").sortWithinPartitions("anchor", "region").mapInArrow(run, _JUDGED)


def _past_references(contents: DataFrame, window: int) -> DataFrame:
    """_JUDGED: the repeated windows of hot anchors, whose regions stream past their anchor's reference."""
    reference = materialise(contents.filter("lead").groupBy("anchor").agg(F.min("words").alias("reference")), "substring-reference")
    reference = broadcast_if(reference, reference.count() <= REFERENCE)
    schema = pa.schema([("anchor", pa.int64()), ("region", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata: dict[int, Automaton] = {}
        hits: set[int] = set()  # windows of references that another region has, too

        def told() -> list[tuple]:
            rows = [(None, None, None, None, h, 1) for h in hits]
            hits.clear()
            return rows

        for batch in batches:
            for part in _slices([batch]):
                rows: list[tuple] = []
                for anchor, region, n, lead, data, ref in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = np.frombuffer(data, np.uint64)
                    one = np.arange(len(words) - window + 1)
                    h = Hashes(words).spans(one, one + window).view(np.int64)
                    flags = np.zeros(len(one), bool)
                    if not lead:
                        auto = automata.get(anchor)
                        if auto is None:
                            if len(automata) >= AUTOMATA:
                                automata.clear()
                            auto = automata[anchor] = Automaton()
                            auto.add(np.frombuffer(ref, np.uint64).tolist(), 1)
                            auto.close()
                        flags = np.array([k == window for k, _ in auto.matches(words.tolist(), window)][window - 1 :])
                    hits.update(h[flags].tolist())
                    rows += [(anchor, region, i, j, None, None) for i, j in zip(*(x.tolist() for x in runs(flags)), strict=True)]
                    rows += [(anchor, region, i, i, x, n) for i, x in zip(one[~flags].tolist(), h[~flags].tolist(), strict=True)]
                if len(hits) > MEMO:
                    rows += told()
                if rows:
                    yield _batch(list(zip(*rows, strict=True)), schema)
        if hits:
            yield _batch(list(zip(*told(), strict=True)), schema)

    once = contents.groupBy("anchor", "region").agg(F.min("n").alias("n"), F.max("lead").alias("lead"), F.min("words").alias("words"))
    met = materialise(once.join(reference, "anchor").select("anchor", "region", "n", "lead", "words", "reference").mapInArrow(run, _JUDGED + ", h long, n long"), "substring-hot")
    again = materialise(met.filter("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 2").select("h"), "substring-windows")
    rest = met.filter("h IS NOT NULL AND region IS NOT NULL").join(again, "h")
    return met.filter("h IS NULL").select("anchor", "region", "first", "last").union(rest.select("anchor", "region", "first", "last"))


def frequent(sizes: DataFrame) -> int:
    """How many places an anchor needs to be broadcast: the least power of two such that those anchors have BROADCAST words at most."""
    words = {r.k: r.w for r in sizes.groupBy(F.floor(F.log2("places")).cast("int").alias("k")).agg(F.sum("words").alias("w")).collect()}  # at most 63 rows
    total = 0
    for k in range(max(words, default=0), -1, -1):
        total += words.get(k, 0)
        if total > BROADCAST:
            return 1 << (k + 1)
    return 1


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, ranges (array of first and last repeated window) of documents that have any."""
    filed = materialise(_filed(docs, window), "substring-regions")
    anchors = filed.groupBy("anchor").agg(F.count("*").alias("n")).filter("n >= 2").select("anchor")
    anchors = materialise(anchors, "substring-anchors")  # so that the join's hot partitions can be split
    met = materialise(filed.join(anchors, "anchor"), "substring-met")
    discard(filed, anchors)
    known = materialise(met.groupBy("anchor", "region").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "at", "many")).alias("first")), "substring-kinds")
    size = known.groupBy("anchor").agg(F.sum(F.col("first.many") + window - 1).alias("words"), F.sum("n").alias("places"), F.max(F.struct("n", "region"))["region"].alias("lead"))
    size = materialise(size, "substring-sizes")
    way = F.when(F.col("words") > SHARD, "hot").when(F.col("places") >= frequent(size.filter(F.col("words") <= SHARD)), "broadcast")
    chosen = materialise(size.select("anchor", way.alias("way"), F.col("lead").alias("_lead")).filter("way IS NOT NULL"), "substring-chosen")
    kinds = known.join(chosen, "anchor", "left").select("anchor", "region", "n", "first", F.coalesce(F.col("region") == F.col("_lead"), F.lit(False)).alias("lead"), F.coalesce("way", F.lit("shard")).alias("way"))
    contents = materialise(_contents(docs, kinds, window), "substring-contents")
    discard(known)
    judged = _past_automata(contents.filter("way = 'broadcast'"), window).union(_in_shards(contents.filter("way = 'shard'"), window))
    if chosen.filter("way = 'hot'").head(1):
        judged = judged.union(_past_references(contents.filter("way = 'hot'"), window))
    judged = materialise(judged.groupBy("anchor", "region").agg(F.collect_list(F.struct("first", "last")).alias("r")), "substring-judged")
    discard(contents)
    ranges = F.transform("r", lambda x: F.struct((F.col("at") + x["first"]).alias("first"), (F.col("at") + x["last"]).alias("last")))
    found = met.join(judged, ["anchor", "region"]).select("doc_id", "key", F.explode(ranges).alias("x"))
    ranges = materialise(found.groupBy("doc_id", "key").agg(F.collect_set("x").alias("ranges")), "substring-ranges")
    discard(met, judged)
    return ranges


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), spans (start, length of removed words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for doc_id, text, found in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                words, spans, n = (text or b"").split(), [], 0
                total = len(words)
                if found:
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, [r["first"] for r in found], 1)
                    np.add.at(edge, [r["last"] + window for r in found], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = list(compress(words, (~gone).tolist()))
                    spans = [{"start": i, "length": j - i + 1} for i, j in zip(*(x.tolist() for x in runs(gone)), strict=True)]
                    n = int(gone.sum())
                rows.append((doc_id, total, n, b" ".join(words).decode(), spans))
            if rows:
                yield _batch(list(zip(*rows, strict=True)), schema)

    return _with_ranges(docs, repeats(docs, window), others=True).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start int, length int>>")
