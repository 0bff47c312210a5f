"""Hierarchical multi-length packing.

Each task encodes its documents once, cuts whole long windows off very long ones and routes what is left to the
tier of its length. Tiers are packed from the longest down: a window opens with its tier's largest piece, gaps are
filled with the largest pieces of this or shorter tiers that fit, and a last gap by cutting the shortest piece, so
windows are full. What is left at a task's end goes to windows of ever smaller powers of two, so nothing is padded.
Windows of one tier are dealt to step groups by their attention cost, from the dearest on to and fro over the groups.
A tokenizer that lower-cases and drops white space is fed word by word, with a memory of words; texts are encoded
whole with any other. Nothing shuffles: a task's windows carry its partition number in their id.

Cases: null and empty texts are documents of one token, the end; repeated rows and null ids are packed like any
other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import kept
from .tokens import tokenizer

TIERS = (512, 1024, 2048, 4096)
END = 2
#: Words remembered by a worker, and encoded in a run.
MEMO, RUN, MARK = 900_000, 200, "\x01"
#: Length of words that are kept when room is made.
SHORT = 8
#: Tokens gathered before a task packs, and windows in a step group.
BLOCK, STEP = 1 << 20, 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
# Fixed value: the pattern of tokenizers that take words.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS, _ODD = re.compile(r"[^ \t\n\r]+"), re.compile("[\x1c-\x1f]")
#: Characters beyond those of which lower case and composition are one to one and free of context.
_FAR = re.compile("[^\x00-\u024f]")


def forget(memo: dict) -> None:
    """Makes room: long words, which are rare, go first; all go if that is not enough."""
    kept = {w: x for w, x in memo.items() if len(w) <= SHORT}
    memo.clear()
    if len(kept) <= MEMO // 2:
        memo.update(kept)


def takes_words(made: dict) -> bool:
    """Whether a tokenizer composes and lower-cases texts, and cuts them into runs of letters, digits or other signs without white space."""
    steps = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
    cuts = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
    runs = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["pattern"].get("Regex") == RUNS and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
    return steps == ["NFC", "Replace", "Lowercase"] and runs and all(c["type"] == "ByteLevel" and not c["use_regex"] and not c["add_prefix_space"] for c in cuts[1:])


class Words(dict):
    """Ids of white-space separated words as little-endian bytes, bounded in entries."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = tokenizer(path)
        self.by_words = takes_words(json.loads(self.tokenizer.to_str()))
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def lower(self, text: str) -> str:
        """The text in lower case, as the tokenizer does; fewer words to remember. Special tokens are found before
        that, so a text where lower case makes one up or breaks one stays as it is."""
        if _FAR.search(text):
            return text
        low = text.lower()
        return low if all(low.count(x) == text.count(x) for x in self.special) else text

    def learn(self, new: list[str]) -> None:
        """Encodes words many at a time, with a control character between them, which is a token of its own."""
        odd = [w for w in new if MARK in w]
        new = [w for w in new if MARK not in w] if odd else new
        runs = [new[at : at + RUN] for at in range(0, len(new), RUN)] + [[w] for w in odd]
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        for run, x in zip(runs, self.tokenizer.encode_batch_fast([f" {MARK} ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == mark[0]), len(ids)) if len(mark) == 1 and len(run) > 1 else np.array([len(ids)])
            if len(ends) == len(run):
                data, ends = ids.tobytes(), ends.tolist()
                self.update(zip(run, (data[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends)), strict=True))
            else:
                self.update((w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in run)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts. Where the pattern never spans white space, words are encoded one by one."""
        if not self.by_words:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        texts = list(map(self.lower, texts))
        split = [_WORDS.findall(t) if _ODD.search(t) else t.split() for t in texts]
        if len(self) > MEMO:
            forget(self)
        new = {w for w in set().union(*split) if w not in self}
        if stopped := [w for w in new if w[-1] in ".," and len(w) > 1 and "a" <= w[-2] <= "z"]:
            # A letter and a stop are never of one token, so the word before the stop is enough.
            new.difference_update(stopped)
            new.update(b for w in stopped if (b := w[:-1]) not in self)
            new.update(c for c in ".," if c not in self)
        self.learn(list(new))
        self.update((w, self[w[:-1]] + self[w[-1]]) for w in stopped)
        return [b"".join(map(self.__getitem__, ws)) for ws in split]


@cache
def words(path: str) -> Words:
    """The worker's memory of words."""
    return Words(path)


kept(words.cache_clear)


class Packer:
    """Packs one task's documents; yields rows of SCHEMA as tuples."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.base, self.windows, self.steps = tiers, base, 0, 0
        self.docs: dict[int, tuple] = {}
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # of (length, document, start), ascending
        self.left = self.seen = 0
        self.out: list[tuple] = []  # (tier, cost, rows)

    def add(self, doc_id: int, ids: bytes) -> None:
        """Routes a document; whole long windows leave at once."""
        k, n, top = self.seen, len(ids) // 4, self.tiers[-1]
        self.seen += 1
        self.docs[k] = (doc_id, ids, n)
        start = 0
        while n - start >= top:
            self.window([(top, k, start)], top)
            start += top
        if start < n:
            self.put((n - start, k, start))
            self.left += n - start
        else:
            del self.docs[k]

    def put(self, piece: tuple[int, int, int]) -> None:
        """Into the pool of the shortest tier that holds it."""
        insort(self.pools[next(i for i, t in enumerate(self.tiers) if piece[0] <= t)], piece)

    def largest(self, most: int, tier: int) -> tuple[int, int, int] | None:
        """Takes the largest piece of at most so many tokens from this tier or shorter ones."""
        for pool in reversed(self.pools[: tier + 1]):
            if at := bisect_right(pool, (most, 1 << 62, 0)):
                return pool.pop(at - 1)
        return None

    def fill(self, size: int, tier: int) -> None:
        """One full window of the given size. There are at least so many tokens left."""
        pieces, gap = [], size
        while gap:
            piece = self.largest(gap, tier)
            if piece is None:
                n, k, start = next(pool for pool in self.pools if pool).pop(0)
                piece = (gap, k, start)
                self.put((n - gap, k, start + gap))
            pieces.append(piece)
            gap -= piece[0]
        self.left -= size
        self.window(pieces, size)

    def window(self, pieces: list[tuple[int, int, int]], tier: int) -> None:
        """Writes a window's rows."""
        rows, offset, at = [], 0, self.base | self.windows
        self.windows += 1
        for n, k, start in pieces:
            doc_id, ids, total = self.docs[k]
            rows.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), total, at, offset, tier))
            offset += n
        self.out.append((tier, sum(p[0] ** 2 for p in pieces), rows))

    def pack(self, last: bool = False) -> None:
        """Packs what has been gathered, longest tier first; at the end, the rest as powers of two."""
        for i in range(len(self.tiers) - 1, -1, -1):
            while self.pools[i] and self.left >= self.tiers[i]:
                self.fill(self.tiers[i], i)
        size = self.tiers[-1]
        while last and self.left:
            if self.left >= size:
                self.fill(size, len(self.tiers) - 1)
            else:
                size //= 2
        self.docs = {k: self.docs[k] for pool in self.pools for _, k, _ in pool}

    def rows(self) -> list[tuple]:
        """Takes the rows so far, with step groups."""
        out: list[tuple] = []
        for tier in sorted({x[0] for x in self.out}):
            mine = sorted((x for x in self.out if x[0] == tier), key=lambda x: -x[1])
            n = -(-len(mine) // STEP)
            for at, (_, _, rows) in enumerate(mine):
                turn, place = divmod(at, n)  # to and fro, so that every group gets dear and cheap windows
                step = self.base | (self.steps + (place if turn % 2 == 0 else n - 1 - place))
                out += [(*r, step) for r in rows]
            self.steps += n
        self.out = []
        return out


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row for each piece. path: the tokenizer's file, the same on all hosts."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40, tiers)

        def batch() -> Iterator[pa.RecordBatch]:
            if rows := packer.rows():
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        end = END.to_bytes(4, "little")
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for doc_id, ids in zip(part.column(0).to_pylist(), words(path).encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    packer.add(doc_id, ids + end)
                if packer.left >= BLOCK:
                    packer.pack()
                    yield from batch()
        packer.pack(last=True)
        yield from batch()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
