r"""Token counts with overlap resynchronisation.

A text is encoded in overlapping chunks, with offsets; a text of at most CHUNK characters is one chunk. Two
neighbours are spliced at a common boundary in their overlap: a character where a token of both encodings starts,
and which is proven stable, a blank after a character that is not white space. No alternative of the byte-level
pattern spans such a place, so the tokens on either side do not depend on what lies beyond it. Where an overlap has
no such boundary, it is widened to the left, twice as far each time, at last to the last splice; if that does not
help either, both chunks become one, and the next is twice as long. So work stays in proportion to the text.

The proof is for byte-level pre-tokenizers without a normalizer; a text is encoded whole with any other tokenizer.

Cases: null and empty texts have 0 tokens; repeated rows and null ids are counted like any other; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk and of an overlap; chunks encoded in a call.
CHUNK, OVERLAP, CALL = 4_096, 128, 256
#: A blank after a character that is not white space.
STABLE = re.compile(r"(?<=\S)[ \n\r\t]")


@cache
def tokenizer(path: str):
    """The worker's tokenizer, loaded once."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


@cache
def has_stable_places(path: str) -> bool:
    """Whether blanks after other characters are token borders: byte-level pattern, no normalizer, plain added tokens."""
    made = json.loads(tokenizer(path).to_str())
    pre = made["pre_tokenizer"] or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or re.search(r"\s", t["content"])) for t in made["added_tokens"])
    return made["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space") and plain


def token_at(encoding, at: int) -> int | None:
    """Number of the token that starts at a character; null if none does."""
    found = encoding.char_to_token(at)
    return found if found is not None and encoding.token_to_chars(found)[0] == at else None


def boundary(text: str, left, left_at: int, right, right_at: int, low: int, high: int) -> tuple[int, int, int] | None:
    """The last stable character in low..high-1 where both encodings have a token start, and the tokens' numbers."""
    for m in reversed(list(STABLE.finditer(text, low, high))):
        i, j = token_at(left, m.start() - left_at), token_at(right, m.start() - right_at)
        if i is not None and j is not None:
            return m.start(), i, j
    return None


def spans(size: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Begin and end of a text's chunks."""
    end = 0
    while True:
        begin, end = max(0, end - overlap), min(size, end + chunk)
        yield begin, end
        if end >= size:
            return


def spliced(text: str, chunks: Iterator[tuple[int, int, object]], encode, overlap: int = OVERLAP) -> tuple[int, int]:
    """Token count of a text from its encoded chunks (begin, end, encoding), and how often an overlap was widened."""
    begin, end, left = next(chunks)
    total = widened = done = skip = 0  # tokens before `done`, the last splice, are counted; `skip` of `left` stand before it
    reach = 0
    for start, far, right in chunks:
        if far < min(reach, len(text)):
            continue
        wide = overlap
        if start > end - wide:  # the chunks between were passed over
            start = max(done, end - wide)
            right = encode(text[start:far])
        while (found := boundary(text, left, begin, right, start, max(done, start) + 1, end)) is None and start > done:
            wide, widened = 2 * wide, widened + 1
            start = max(done, end - wide)
            right = encode(text[start:far])
        if found:
            done, at, first = found
            total, skip = total + at - skip, first
        else:  # nothing to splice at since the last place: `right` began there, and is both chunks in one
            widened, skip, reach = widened + 1, 0, done + 2 * (far - done)
        begin, end, left = start, far, right
    return total + len(left) - skip, widened


def count(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Tokens of each text, and how often its overlaps were widened. Chunks of many texts are encoded together."""
    tok = tokenizer(path)
    if not has_stable_places(path):
        yield from ((len(tok.encode(t, add_special_tokens=False)), 0) for t in texts)
        return

    def encoded() -> Iterator[tuple[int, int, int, object]]:
        todo = ((i, a, b) for i, t in enumerate(texts) for a, b in spans(len(t), chunk, overlap))
        while part := list(islice(todo, CALL)):
            found = tok.encode_batch([texts[i][a:b] for i, a, b in part], add_special_tokens=False)
            yield from ((*x, e) for x, e in zip(part, found, strict=True))

    for i, group in groupby(encoded(), key=lambda x: x[0]):
        yield spliced(texts[i], ((a, b, e) for _, a, b, e in group), lambda s: tok.encode(s, add_special_tokens=False), overlap)


def counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, and n_chunks and n_widened of its encoding.

    path: the tokenizer's file, the same on all hosts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n, widened = zip(*count(texts, path), strict=True)
                chunks = [sum(1 for _ in spans(len(t))) for t in texts]
                more = [pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(chunks, pa.int64()), pa.array(widened, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *more], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select("doc_id", "text", size).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long")
