"""WARC archives with a two-level capture index.

Writing: each task streams its pages into an archive of its own, one gzip member for each record; a page whose
payload equals that of a page of smaller id becomes a revisit of it. First level: the captures, sorted by reversed
host and page, in compressed blocks. Second level: a sparse directory with the first and last key of each block.
Reading: sorted keys search the part of the directory they span by bisection, then the block, then read one range
of an archive. File names are unique for each attempt, and only files of finished attempts are listed, so retried
and speculative tasks leave nothing wrong behind.

Cases: null html is an empty payload; a null url has the key of an empty host; pages that repeat id and payload are
records of one kind, all response if theirs is the smallest id; a null page_id is larger than all others; an empty
table writes no records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, materialise, new_path

#: Index lines in a block; bytes after which a task starts another archive; revisits that are broadcast; open files.
LINES, ROLL, REVISITS, OPEN = 256, 1 << 30, 1_000_000, 16
#: Keys that are searched at a time, and bytes of payloads in a batch.
KEYS, BATCH = 2_000, 8 << 20
ENTRY = "key string, page_id long, file string, start long, length long"
BLOCK = "first string, last string, file string, start long, length long, lines int"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Upper-case base32 SHA-1 of a binary column: five hex digits are four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def surt(url: str | None) -> str:
    """Sort-friendly key of a URL: reversed host, then path and query."""
    try:
        x = urlsplit(url or "")
        host = ",".join(reversed((x.hostname or "").split("."))) + (f":{x.port}" if x.port else "")
    except ValueError:
        return ")" + (url or "")
    return f"{host}){x.path or '/'}" + (f"?{x.query}" if x.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """The index key of one capture. Blanks and control characters of URLs are escaped."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in surt(url)) + f" {'' if page_id is None else page_id}"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress(("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + gzip.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}" != headers["WARC-Block-Digest"]:
        raise ValueError("damaged WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _number(urn: str) -> int | None:
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes archives into the shared folder. Returns ENTRY rows: where each record is."""
    out = new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload).alias("digest"))
    known = materialise(pages.select("page_id", "digest", F.length("payload").alias("n")), "warc-digests").filter(F.col("n") >= least)
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL").drop("n")
    first = materialise(first, "warc-first")  # so that the join's hot partitions can be split
    again = known.drop("n").join(first, "digest").filter("page_id IS DISTINCT FROM refers_to").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to").distinct()
    again = materialise(again, "warc-revisits")
    again = broadcast_if(again, again.count() <= REVISITS)
    rows = pages.join(again, pages.page_id.eqNullSafe(again._p) & (pages.digest == again._d), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(out)
        fs.create_dir(folder, recursive=True)
        sink, name, start = None, "", 0
        for batch in batches:
            lines = []
            for page_id, url, data, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    name, start = f"{uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(f"{folder}/{name}", compression=None)
                member = record(page_id, url, data, digest, refers_to, refers_to is not None)
                sink.write(member)
                lines.append((capture_key(url, page_id), page_id, f"{out}/{name}", start, len(member)))
                start += len(member)
                if start >= ROLL:
                    sink.close()
                    sink = None
            if lines:
                yield _batch(lines, ENTRY)
        if sink is not None:
            sink.close()

    return materialise(rows.mapInArrow(run, ENTRY), "warc-entries")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(list(zip(*rows, strict=True)) or [[]] * len(fields), fields, strict=True)], [n for n, _ in fields])


def index(entries: DataFrame, lines: int = LINES) -> str:
    """Writes both levels of the index. Returns the directory's path, a Parquet table of BLOCK rows sorted by key."""
    spark = entries.sparkSession
    out = new_path(spark, "warc-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(out)
        fs.create_dir(folder, recursive=True)
        sink, name, start, held = None, f"{uuid4().hex}.cdx", 0, []

        def flush() -> pa.RecordBatch:
            nonlocal start
            block = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode(), 6)
            sink.write(block)
            row = (held[0][0], held[-1][0], f"{out}/{name}", start, len(block), len(held))
            start += len(block)
            held.clear()
            return _batch([row], BLOCK)

        for batch in batches:
            sink = sink or fs.open_output_stream(f"{folder}/{name}", compression=None)
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                held.append(row)
                if len(held) >= lines:
                    yield flush()
        if held:
            yield flush()
        if sink is not None:
            sink.close()

    path = new_path(spark, "warc-directory")
    parts = max(1, -(-entries.count() // 4_000_000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries.repartitionByRange(parts, "key", "file", "start").sortWithinPartitions("key", "file", "start").mapInArrow(run, BLOCK).write.parquet(path)
    return path


class Files:
    """A few open files."""

    def __init__(self):
        self.open: OrderedDict = OrderedDict()

    def range(self, uri: str, start: int, length: int) -> bytes:
        f = self.open.pop(uri, None)
        if f is None:
            fs, path = _fs(uri)
            f = fs.open_input_file(path)
        self.open[uri] = f
        if len(self.open) > OPEN:
            self.open.popitem(last=False)[1].close()
        return f.read_at(length, start)


class Lookup:
    """Finds captures in the index, for keys that come sorted."""

    def __init__(self, directory: str):
        import pyarrow.dataset as ds

        fs, path = _fs(directory)
        self.directory, self.field = ds.dataset(path, filesystem=fs, format="parquet"), ds.field
        self.files, self.block, self.lines = Files(), None, ([], [])
        self.blocks: list[dict] = []

    def span(self, low: str, high: str) -> None:
        """Loads the part of the directory between two keys; Parquet statistics skip the rest."""
        found = self.directory.to_table(filter=(self.field("last") >= low) & (self.field("first") <= high))
        self.blocks = sorted(found.to_pylist(), key=lambda b: (b["first"], b["last"], b["file"], b["start"]))
        self.firsts, self.lasts = [b["first"] for b in self.blocks], [b["last"] for b in self.blocks]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """file, start, length of the captures of a key."""
        out = []
        for i in range(bisect_left(self.lasts, key), bisect_right(self.firsts, key)):
            b = self.blocks[i]
            if self.block != (b["file"], b["start"]):
                rows = [x.split("\t") for x in zlib.decompress(self.files.range(b["file"], b["start"], b["length"])).decode().split("\n")]
                self.block, self.lines = (b["file"], b["start"]), ([r[0] for r in rows], rows)
            keys, rows = self.lines
            out += [(r[1], int(r[2]), int(r[3])) for r in rows[bisect_left(keys, key) : bisect_right(keys, key)]]
        return out


def read(spark: SparkSession, pages: DataFrame, directory: str) -> DataFrame:
    """Looks the pages up by url and id, and reads their records: page_id, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, schema.types, strict=True)], schema=schema)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for u, p in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)], pa.string())], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, files = None, Files()
        for batch in batches:
            for at in range(0, batch.num_rows, KEYS):
                keys = batch.column(0).slice(at, KEYS).to_pylist()
                lookup = lookup or Lookup(directory)  # once in a task
                lookup.span(keys[0], keys[-1])
                rows, size = [], 0
                for member in (files.range(*x) for k in keys for x in lookup.find(k)):
                    headers, http, payload = parse(member)
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError("a payload does not match its digest")
                    n = int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
                    rows.append((_number(headers["WARC-Record-ID"]), None if revisit else payload, n, digest, headers["WARC-Type"], _number(headers["WARC-Refers-To"]) if revisit else None))
                    size += len(payload)
                    if size >= BATCH:
                        yield _table(rows)
                        rows, size = [], 0
                yield _table(rows)

    keys = pages.select("page_id", "url").mapInArrow(name, "key string").distinct()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes, indexes and reads back all pages."""
    return read(pages.sparkSession, pages, index(write(pages, least)))
