"""A ledger of model answers: no answered prompt is asked again, and equal prompts are asked once.

A prompt's key is a digest of the model's name and its text. Prompts whose key has an answer in the ledger are not asked;
of the others each distinct one goes to one task, which has several requests in flight and appends the answers of each
batch as a file of the ledger as soon as they are there. So a job that dies has lost the requests in flight at most: the
next one reads what was appended, and so does another attempt of the same task. The answers are then joined to the prompts.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ranges import uri_of

SCHEMA = pa.schema([("key", pa.string()), ("raw_response", pa.string()), ("status", pa.string()), ("attempts", pa.int32())])
DDL = "key string, raw_response string, status string, attempts int"


def _folder(uri: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


def append(uri: str, name: str, rows: list[tuple]) -> None:
    """One file of answers. It gets its name when it is whole, so that no reader sees a part of it."""
    import pyarrow.parquet as pq

    fs, root = _folder(uri)
    fs.create_dir(root, recursive=True)
    data = io.BytesIO()
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA), data)
    at = f"{root}/_{name}"
    with fs.open_output_stream(at, compression=None) as out:
        out.write(data.getvalue())
    fs.move(at, f"{root}/{name}.parquet")


def answered(uri: str, start: str) -> set[str]:
    """Keys with an answer in the files whose names start so."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, root = _folder(uri)
    found: set[str] = set()
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.startswith(start):
            with fs.open_input_file(f.path) as data:
                t = pq.read_table(data, columns=["key", "status"])
            found |= {k for k, s in zip(*(c.to_pylist() for c in t.columns), strict=True) if s == "ok"}
    return found


@dataclass(frozen=True)
class LedgerAnnotator:
    """An annotator that answers prompts one by one (model, answer(prompt) -> response, status, attempts), behind a ledger.

    path: the ledger's folder, one for all models; tasks: partitions that ask; in_flight: requests of a task at a time, so
    tasks * in_flight bounds the server's load; batch: answers of a file. Errors are written too, and asked again next time.
    """

    annotator: Any
    path: str
    tasks: int = 1
    in_flight: int = 4
    batch: int = 32

    @property
    def model(self) -> str:
        """The model's name."""
        return self.annotator.model

    def known(self, df: DataFrame) -> DataFrame:
        """The ledger, one row for each key, an answer before an error."""
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = fs.exists(p) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p))
        rows = spark.read.schema(DDL).parquet(self.path) if there else spark.createDataFrame([], DDL)
        best = F.max_by(F.struct("raw_response", "status", "attempts"), F.col("status") == "ok")
        return rows.groupBy("key").agg(best.alias("a")).select("key", "a.*")

    def ask(self, open_prompts: DataFrame) -> int:
        """Asks the prompts (key, prompt) and appends the answers. Returns how many were asked."""
        spark, run_id = open_prompts.sparkSession, uuid.uuid4().hex
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path))
        uri = uri_of(spark, self.path)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = f"{run_id}-{TaskContext.get().partitionId()}-"
            done = answered(uri, mine)  # by an earlier attempt of this task
            n = 0

            def written(part: list[tuple[str, str]], pool: ThreadPoolExecutor) -> int:
                got = pool.map(lambda row: (row[0], *self.annotator.answer(row[1] or "")), part)
                rows, failed = [], None
                while True:  # what was answered before a failure is written all the same
                    try:
                        rows.append(next(got))
                    except StopIteration:
                        break
                    except Exception as e:  # noqa: BLE001
                        failed = e
                        break
                if rows:
                    append(uri, mine + uuid.uuid4().hex, rows)
                if failed is not None:
                    raise failed
                return len(rows)

            with ThreadPoolExecutor(self.in_flight) as pool:
                part: list[tuple[str, str]] = []
                for b in batches:
                    for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        if row[0] not in done:
                            part.append(row)
                        if len(part) == self.batch:
                            n += written(part, pool)
                            part = []
                if part:
                    n += written(part, pool)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        # One job with an action of its own: the answers are in the ledger, and nothing reads the count twice.
        return open_prompts.repartition(self.tasks, "key").select("key", "prompt").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0

    def annotate(self, chunks: DataFrame) -> DataFrame:
        """Adds model, raw_response, status, attempts to rows with a prompt; asks what the ledger does not have."""
        keyed = chunks.withColumn("_key", F.sha2(F.concat(F.lit(self.model + "\n"), F.coalesce("prompt", F.lit(""))), 256))
        have = self.known(chunks).filter("status = 'ok'").select("key")
        self.ask(keyed.select(F.col("_key").alias("key"), "prompt").dropDuplicates(["key"]).join(have, "key", "left_anti"))
        known = self.known(chunks)
        met = keyed.join(known, keyed._key == known.key, "left")
        return met.select(*chunks.columns, F.lit(self.model).alias("model"), "raw_response", F.coalesce("status", F.lit("error")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"))
