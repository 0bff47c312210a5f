r"""Cross-tokenizer alignment by interval coalescing.

Each text is encoded by two tokenizers, and every token becomes an interval of bytes. All intervals of a batch, of both
tokenizers, are sorted by start; the running maximum of their ends tells where groups break: where a start reaches it,
no token of either side spans that byte. Within a group every token of one side overlaps the same bytes as every token
of the other, and the pairs expand there: occurrences link. How many documents hold an id pair linked is counted over
the whole corpus, and each document then sums over its links.

Plan. One Python pass over the texts gives a row for each document with its distinct id pairs and how often each is
linked; it is written once. Counting explodes the pairs: a partial count in each task, then a shuffle by pair, which is
one row of a task for each pair. The counts go back to the documents in two ways at once, so that no key is hot and no
broadcast grows: pairs of at least `most` documents, where `most` is the least power of two that leaves HEAD pairs or
fewer, are broadcast; the others, each in fewer documents than that, join by shuffle.

A group's pairs expand in blocks of BLOCK; a group of many tokens is first reduced to distinct ids with their numbers,
so a long run of text without a common boundary costs its distinct ids and not the product of its lengths.

Cases: null and empty texts, and texts that either tokenizer does not give back byte for byte, have zeros and an empty
digest; every row counts as a document of its own, so repeated rows, and null or repeated ids, are all there; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Pairs of a block; tokens of a group past which it is reduced to distinct ids first; characters encoded in a call.
BLOCK, WIDE, CALL = 1 << 20, 64, 400_000
#: Most id pairs whose counts are broadcast, 16 bytes each.
HEAD = 1 << 14
#: An id of the second tokenizer fits in so many bits, and a pair; the rest of a key is the number of a document in its call.
BITS, KEY = 20, 40
SPACE = "▁"


class ByteLevel:
    """A byte-level BPE file of `tokenizers`; special strings in texts are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        plain = _plain_bytes()
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = entry.encode() if entry in added else bytes(plain[c] for c in entry)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text behind a space."""
        return [e.ids for e in self.tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model with byte fallback, which puts a space before each text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        whole = lambda i: bytes([int(self.sp.id_to_piece(i)[1:-1], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).replace(SPACE, " ").encode()
        self.bytes = [whole(i) for i in range(self.sp.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return self.sp.encode(texts, num_threads=1)


def _plain_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _tables(kind: type, path: str):
    """The worker's tokenizer, loaded once, with the length of each id's bytes and its decimal text behind each separator."""
    tok = kind(path)
    return tok, np.array([len(b) for b in tok.bytes], np.int64), np.array([mark + str(i) for i in range(len(tok.bytes)) for mark in ("", ";", "|", ",")], object)


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of intervals by start and side, and the group of each in that order.

    A group breaks where a start reaches the running maximum of the ends before it.
    """
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(fresh) - 1


def _spread(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _distinct(group: np.ndarray, ids: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, id, number, sorted by group; only in `wide` groups are equal ids drawn together."""
    one = ~wide[group]
    g, i = group[~one], ids[~one]
    key, n = np.unique(g * (1 << 32) + i, return_counts=True)
    g, i, n = np.concatenate([group[one], key >> 32]), np.concatenate([ids[one], key & 0xFFFFFFFF]), np.concatenate([np.ones(one.sum(), np.int64), n])
    order = np.argsort(g, kind="stable")
    return g[order], i[order], n[order]


def links(doc_of: np.ndarray, ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, pair and number of links, distinct and sorted, of tokens a in groups ga with tokens b in groups gb, both sorted by group.

    doc_of: the document of each group. A pair is the first id times 2^BITS plus the second.
    """
    size = len(doc_of)
    wide = (np.bincount(ga, minlength=size) > WIDE) & (np.bincount(gb, minlength=size) > WIDE)
    ga, a, na = _distinct(ga, a, wide)
    gb, b, nb = _distinct(gb, b, wide)
    per, first = np.bincount(gb, minlength=size), np.searchsorted(gb, np.arange(size))
    each = per[ga]  # partners of each token of a
    docs, pairs, counts = [], [], []
    done = np.concatenate([[0], np.cumsum(each)])
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(done, done[at] + block, "right")) - 1)  # a token has at most a vocabulary of partners
        n = each[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.repeat(first[ga[at:to]], n) + _spread(n)
        d, p, w = doc_of[ga[i]], (a[i] << BITS) + b[j], na[i] * nb[j]
        order = np.argsort((d << KEY) + p)  # one key: a call has few documents
        d, p, w = d[order], p[order], w[order]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])])) if len(d) else np.zeros(0, np.int64)
        docs.append(d[new])
        pairs.append(p[new])
        counts.append(np.add.reduceat(w, new) if len(new) else w)
        at = to
    if len(docs) == 1:
        return docs[0], pairs[0], counts[0]
    if not docs:
        return (np.zeros(0, np.int64),) * 3
    d, p, w = np.concatenate(docs), np.concatenate(pairs), np.concatenate(counts)
    order = np.lexsort((p, d))
    d, p, w = d[order], p[order], w[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])]))
    return d[new], p[new], np.add.reduceat(w, new)


def aligned(texts: list[str], first: str, second: str, block: int = BLOCK) -> tuple[list, list, list, list, np.ndarray, np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups and the groups' text of each text, and doc, pair, number of all links. None: texts without tokens."""
    (ta, la, sa), (tb, lb, sb) = _tables(ByteLevel, first), _tables(Pieces, second)
    say = sa if len(sa) >= len(sb) else sb
    ids = []
    for x, y, t in zip(ta.encode(texts), tb.encode(texts), texts, strict=True):
        raw = (" " + t).encode()
        same = t != "" and b"".join(map(ta.bytes.__getitem__, x)) == raw and b"".join(map(tb.bytes.__getitem__, y)) == raw
        ids.append((x, y) if same else ([], []))
    a, b = (np.fromiter(chain.from_iterable(pair[s] for pair in ids), np.int64, sum(len(pair[s]) for pair in ids)) for s in (0, 1))
    na, nb = ([len(pair[s]) for pair in ids] for s in (0, 1))
    ea, eb = np.cumsum(la[a]), np.cumsum(lb[b])  # texts that have tokens are one after the other on one line of bytes
    size_a, size_b = la[a], lb[b]
    start, end = np.concatenate([ea - size_a, eb - size_b]), np.concatenate([ea, eb])
    side = np.repeat([0, 1], [len(a), len(b)])
    order, group = coalesce(start, end, side)
    doc = np.concatenate([np.repeat(np.arange(len(texts)), na), np.repeat(np.arange(len(texts)), nb)])[order]
    side, token = side[order], np.concatenate([a, b])[order]
    # What stands before a token in its document's text: nothing, a new group, the first of side B, or another of its side.
    by = np.argsort(2 * group + side, kind="stable")
    side, token, doc, group = side[by], token[by], doc[by], group[by]
    new_doc, new_group, new_side = (np.concatenate([[True], x[1:] != x[:-1]])[: len(x)] for x in (doc, group, side))
    code = np.where(new_doc, 0, np.where(new_group, 1, np.where(new_side, 2, 3)))
    # Decimal texts with what stands before them, four for each id; both sides write an id alike.
    parts = say[4 * token + code].tolist()
    cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    said = ["".join(parts[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    heads = np.flatnonzero(new_group)
    doc_of = doc[heads]
    n_groups = np.bincount(doc_of, minlength=len(texts)).tolist()
    mine = side == 0
    return na, nb, n_groups, said, *links(doc_of, group[mine], token[mine], group[~mine], token[~mine], block)


def _calls(texts: list[str], most: int = CALL) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def documents(docs: DataFrame, first: str, second: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs (array of pair and n) of every document."""
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,n:long>>"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in _calls(texts):
                na, nb, n_groups, said, doc, pair, n = aligned(texts[i:j], first, second)
                at = np.searchsorted(doc, np.arange(j - i + 1))
                sums = np.concatenate([[0], np.cumsum(n)])[at]
                sha = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
                flat = pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])
                listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
                counts = [pa.array(c, pa.int64()) for c in (na, nb, n_groups, np.diff(sums))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *counts, pa.array(sha), listed], names)

    # One row is one document, whatever its id; the number is fixed once the table is written.
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, n_docs, best (whether no pair of the same first id is in more documents) of (row, pair)."""
    counts = pairs.groupBy("pair").agg(F.count("*").alias("n_docs")).withColumn("a", F.shiftright("pair", BITS))
    top = counts.groupBy("a").agg(F.max("n_docs").alias("_top"))  # at most a vocabulary of rows, 24 bytes each
    return counts.join(F.broadcast(top), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("_top")).alias("best"))


def head_from(counts: DataFrame, head: int = HEAD) -> int:
    """The least power of two such that at most `head` pairs are in so many documents or more."""
    sizes = dict(counts.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("k")).count().collect())  # at most 63 rows
    total = 0
    for k in range(max(sizes, default=0), -1, -1):
        total += sizes.get(k, 0)
        if total > head:
            return 1 << (k + 1)
    return 1


def align(docs: DataFrame, first: str, second: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    first: a byte-level BPE file; second: a sentencepiece model; the same paths on all hosts.
    """
    known = materialise(documents(docs, first, second), "align-documents")
    pairs = known.select("row", F.inline("pairs"))
    counts = materialise(pair_counts(pairs), "align-counts")
    most = head_from(counts, head)
    worth = F.struct(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    sums = pairs.join(F.broadcast(counts.filter(F.col("n_docs") >= most)), "pair").groupBy("row").agg(worth.alias("s"))
    if most > 1:  # the rest, of which no pair is in `most` documents
        rest = pairs.join(F.broadcast(counts.filter(F.col("n_docs") >= most).select("pair")), "pair", "left_anti")
        rest = rest.hint("merge").join(counts.filter(F.col("n_docs") < most), "pair").groupBy("row").agg(worth.alias("s"))
        sums = sums.unionByName(rest)
    total = sums.groupBy("row").agg(F.sum("s.n_best").alias("n_best"), F.sum("s.count_sum").alias("count_sum"))
    out = known.drop("pairs").join(total, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
