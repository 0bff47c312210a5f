"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_kept: list[Callable[[], None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, set here only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have gone before us
            return


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes tables of materialise() that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._scratch)


def in_turn(parts: list, make: Callable, name: str) -> DataFrame:
    """Rows of make(part) for all parts. Several parts run as one job each, appended to one table: so a plan holds one
    part's broadcast at a time, and what reads the table does not know how many there were."""
    if len(parts) == 1:
        return make(parts[0])
    path, first = None, None
    for part in parts:
        df = make(part)
        first = first if first is not None else df
        path = path or new_path(df.sparkSession, name)
        df.write.mode("append").parquet(path)
    return first.sparkSession.read.schema(first.schema).parquet(path)


def broadcast_if(df: DataFrame, fits: bool) -> DataFrame:
    """Broadcast a side whose size has been measured; past the bound, leave it to a shuffled join."""
    return F.broadcast(df) if fits else df


def text_of(column: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """A key of a row by content; rows that repeat id and text share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def without_rows(docs: DataFrame, gone: DataFrame, most: int) -> DataFrame:
    """Whole rows but those in `gone` (doc_id, key of row_key()), and but repeats of id and text, of which one stays.

    gone: broadcast up to `most` rows, else joined by shuffle.
    """
    gone = materialise(gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")), "rows-gone")
    gone = broadcast_if(gone, gone.count() <= most)
    left = docs.join(gone, docs.doc_id.eqNullSafe(gone._id) & (row_key() == gone._key), "left_anti")
    again = docs.groupBy(F.col("doc_id").alias("_id"), row_key().alias("_key")).agg(F.count("*").alias("n")).filter("n > 1").select("_id", "_key")
    again = materialise(again, "rows-again")
    many = again.count()
    if not many:
        return left
    again = broadcast_if(again, many <= most)
    same = docs.doc_id.eqNullSafe(again._id) & (row_key() == again._key)
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def least_hashes(df: DataFrame, key, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, those whose key hashes below a threshold: no task or driver gathers more."""
    return df if total <= rows else df.filter(F.shiftrightunsigned(F.xxhash64(key), 32) < int((1 << 32) * rows / total))


def ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of each element of a list column, from its buffers; null lists have none."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def kept(clear: Callable[[], None]) -> None:
    """Registers how to forget what an operator keeps in a Python worker from task to task."""
    _kept.append(clear)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, as Python objects of whole texts take many times their Arrow size; what other operators keep in this worker goes first."""
    for clear in _kept:
        clear()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
