"""Large JSON files by byte ranges: items of one array, or lines, read by many tasks, numbered in the order of the file.

Where a range of bytes begins, it is not known whether it begins inside a string, nor how deep. So a first job reads each
range under both assumptions and reports, for each: whether it ends inside a string, by how much the depth changes, and
how many commas stand at each depth, counted from where it began. These few numbers of a range are summed up in order,
which settles the state at the start of every range and the number of the first item that begins there. A second job
then cuts the items out: a range owns those that begin in it, and reads on past its end to finish the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, and of each further read where an item ends beyond it.
RANGE, MORE = 16 << 20, 1 << 20
QUOTE, ESCAPE, COMMA, LINE = b'"\\,\n'
OPEN, SHUT = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8)
BLANK = b" \t\r\n"


def uri_of(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as pyarrow takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and size of the file, or of the files of a folder by name, but for those that Spark writes as marks (_SUCCESS)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = [(s.getPath().toString(), s.getLen()) for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p) if s.isFile()]
    return sorted((f, n) for f, n in found if n and not f.rpartition("/")[2].startswith(("_SUCCESS", ".")))


def ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """file (number), uri, start, end, total of each range, a row for each; as many partitions as rows, up to four for each core."""
    rows = [(i, uri_of(spark, f), a, min(a + size, n), n) for i, (f, n) in enumerate(listed(spark, path)) for a in range(0, n, size)]
    df = spark.createDataFrame(rows, "file int, uri string, start long, end long, total long")
    return df.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "file", "start") if rows else df


def reachable(spark: SparkSession, path: str) -> bool:
    """Whether pyarrow knows the file system."""
    import pyarrow.fs as pafs

    try:
        pafs.FileSystem.from_uri(uri_of(spark, path))
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def _open(uri: str):
    import pyarrow.fs as pafs

    fs, name = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(name)


def _escaped(f, start: int) -> bool:
    """Whether the byte at `start` follows an odd number of backslashes."""
    n = 0
    while start - n > 0:
        f.seek(max(0, start - n - 4096))
        part = f.read(min(4096, start - n))
        bare = len(part.rstrip(b"\\"))
        n += len(part) - bare
        if bare:
            break
    return n % 2 == 1


def structure(data: np.ndarray, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are outside of strings (quotes are not), and the positions of quotes that begin or end strings."""
    quotes = np.flatnonzero(data == QUOTE)
    slash = data == ESCAPE
    if slash.any() or escaped:
        other = np.where(~slash, np.arange(len(data)), -1)
        before = np.maximum.accumulate(other)  # the last byte up to here that is no backslash
        last = np.where(quotes > 0, before[quotes - 1], -1)
        run = quotes - 1 - last + np.where(last < 0, int(escaped), 0)
        quotes = quotes[run % 2 == 0]
    flips = np.zeros(len(data) + 1, np.int8)
    flips[quotes] = 1
    state = (np.cumsum(flips[:-1]) + inside) % 2  # 1 from an opening quote on
    outside = state == 0
    outside[quotes] = False
    return outside, quotes


def depths(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Depth after each byte, from 0 before the first."""
    step = np.isin(data, OPEN).astype(np.int64) - np.isin(data, SHUT)
    return np.cumsum(np.where(outside, step, 0))


def _scan(uri: str, start: int, end: int, kind: str) -> Iterator[tuple]:
    """assumed inside, ends inside, change of depth, depths of commas and their numbers (lines: the number of line feeds), first byte that is not blank, last byte."""
    with _open(uri) as f:
        escaped = kind == "array" and _escaped(f, start)
        f.seek(start)
        raw = f.read(end - start)
    edge = ((raw.lstrip(BLANK) or b" ")[0], raw[-1])
    if kind == "lines":
        yield False, False, 0, [0], [raw.count(b"\n")], *edge
        return
    data = np.frombuffer(raw, np.uint8)
    for inside in (False, True):
        outside, quotes = structure(data, escaped, inside)
        depth = depths(data, outside)
        at, n = np.unique(depth[outside & (data == COMMA)], return_counts=True)
        yield inside, bool((len(quotes) + inside) % 2), int(depth[-1]), at.tolist(), n.tolist(), *edge


def scanned(df: DataFrame, kind: str) -> DataFrame:
    """What the ranges report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(r["file"], r["start"], *x) for x in _scan(r["uri"], r["start"], r["end"], kind)]
                types = [pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "start", "inside", "ends", "change", "depths", "commas", "first", "last"])

    return df.mapInArrow(run, "file int, start long, inside boolean, ends boolean, change long, depths array<long>, commas array<long>, first int, last int")


def _items(uri: str, start: int, end: int, total: int, inside: bool, depth: int, index: int) -> Iterator[tuple[int, str]]:
    """Number and text of the elements of the array that begin in a range.

    An element begins with the first byte that is no white space after the array's bracket or a comma of depth 1.
    """
    with _open(uri) as f:
        escaped = _escaped(f, start)
        f.seek(start)
        raw = bytearray(f.read(end - start))
        own = len(raw)
        while True:
            data = np.frombuffer(bytes(raw), np.uint8)
            outside, _ = structure(data, escaped, inside)
            level = depth + depths(data, outside)
            commas = np.flatnonzero(outside & (data == COMMA) & (level == 1))
            # An element begins after the bracket that opens the array or a comma of depth 1, and ends before such a comma or the last bracket.
            opens = np.flatnonzero(outside & (data == OPEN[1]) & (level == 1))[:1] if depth == 0 else commas[:0]
            begins = np.concatenate([opens, commas[commas < own]])
            begins = begins[begins < own]
            stops = np.concatenate([commas, np.flatnonzero(outside & (data == SHUT[1]) & (level == 0))])
            if not len(begins) or len(stops) and stops.max() > begins[-1]:
                break
            more = f.read(max(MORE, len(raw)))  # twice as much each time: work in proportion to the longest element
            if not more:
                break
            raw += more
    if not len(begins):
        return
    text, stops = bytes(raw), np.sort(stops)
    for at, to in zip(begins, np.searchsorted(stops, begins + 1), strict=True):
        index += int(data[at] == COMMA)
        said = text[at + 1 : stops[to]].strip(BLANK) if to < len(stops) else b""
        if said:
            yield index, said.decode(errors="replace")


def _lines(uri: str, start: int, end: int, total: int, index: int) -> Iterator[tuple[int, str]]:
    """Number and text of the lines that begin after a line feed of a range, and of the first line of the file."""
    with _open(uri) as f:
        f.seek(start)
        raw = bytearray(f.read(end - start))
        if start and b"\n" not in raw:
            return
        while start + len(raw) < total:
            more = f.read(MORE)
            at = more.find(b"\n")
            raw += more if at < 0 else more[:at]
            if at >= 0 or not more:
                break
    for i, line in enumerate(bytes(raw).split(b"\n")):
        said = line.strip(BLANK)
        if said and (i or not start):  # what stands before the first line feed belongs to the range before
            yield index + i, said.decode(errors="replace")


def read(spark: SparkSession, path: str, kind: str, size: int = RANGE) -> DataFrame:
    """db_idx, value: texts of the elements of an array file (kind "array") or of the lines ("lines") by their place in the file.

    Files of a folder follow each other by name. Blank lines have a place and no row. A file that is no array, or is cut
    off, has no elements, as reading it whole would fail.
    """
    df = ranges(spark, path, size)
    first, states, index = {}, [], 0
    starts = {(r.file, r.start): (r.uri, r.end, r.total) for r in df.collect()}  # a row for each range
    for r in scanned(df, kind).collect():  # a few numbers of each range
        first[r.file, r.start, r.inside] = r
    by_file: dict[int, list[int]] = {}
    for file, start in sorted(starts):
        by_file.setdefault(file, []).append(start)
    for file, all_starts in by_file.items():
        inside, depth, here = False, 0, []
        at = index
        for start in all_starts:
            r = first[file, start, inside]
            here.append((file, *starts[file, start][:1], start, *starts[file, start][1:], inside, depth, at))
            at += dict(zip(r.depths, r.commas, strict=True)).get((1 - depth) if kind == "array" else 0, 0)
            inside, depth = r.ends, depth + r.change
        if kind == "lines" or depth == 0 and not inside and first[file, 0, False].first == OPEN[1]:
            states += here
            index = at + (kind == "array" or r.last != LINE)
    schema = "file int, uri string, start long, end long, total long, inside boolean, depth long, at long"
    todo = spark.createDataFrame(states, schema)
    todo = todo.repartition(max(1, min(len(states), 4 * spark.sparkContext.defaultParallelism)), "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                where = (r["uri"], r["start"], r["end"], r["total"])
                rows = _items(*where, r["inside"], r["depth"], r["at"]) if kind == "array" else _lines(*where, r["at"])
                found, n = [], 0
                for row in rows:
                    found.append(row)
                    n += len(row[1])
                    if n > MORE:
                        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], ["db_idx", "value"])
                        found, n = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], ["db_idx", "value"])

    return todo.mapInArrow(run, "db_idx long, value string")


def whole(spark: SparkSession, uris: list[str]) -> DataFrame:
    """path, content of files, read by tasks; for the few that Spark's own reader passes over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(uri) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], ["path", "content"])

    df = spark.createDataFrame([(u, uri_of(spark, u)) for u in uris], "path string, uri string")
    return df.repartition(max(1, min(len(uris), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "path string, content binary")


def hidden(spark: SparkSession, path: str, *patterns: str) -> list[str]:
    """Files below a folder that match a pattern and have a part of their name that Spark takes for hidden: one that begins with _ or a dot."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(p(path)).toString()
    found = []
    for pattern in patterns:
        for s in fs.globStatus(p(p(path), pattern)) or []:
            name = s.getPath().toString()
            if s.isFile() and s.getLen() and any(x.startswith(("_", ".")) for x in name.removeprefix(top).strip("/").split("/")):
                found.append(name)
    return sorted(found)
