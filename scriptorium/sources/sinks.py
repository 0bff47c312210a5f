"""Writers: entity JSON, tables, match CSV, HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import uri_of


def entity_documents(entities: DataFrame, keys: tuple[str, ...] = ("model", "doc_name")) -> DataFrame:
    """keys, json: {"entities": [...]} of each document, in order."""
    listed = F.array_sort(F.collect_list(F.struct("chunk_idx", "entity_idx", "text", "label")))
    made = F.transform(listed, lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label")))
    return entities.groupBy(*keys).agg(F.to_json(F.struct(made.alias("entities"))).alias("json"))


def write_entities(entities: DataFrame, path: str) -> None:
    """The canonical form: Parquet, a folder for each model."""
    entities.write.mode("overwrite").partitionBy("model").parquet(path)


def _export(files: DataFrame, path: str) -> int:
    """Writes (name, data) rows as files below a path, through any file system that pyarrow knows. Returns their number."""
    uri = uri_of(files.sparkSession, path)  # without a scheme: the default file system

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def export_entity_files(documents: DataFrame, path: str) -> int:
    """One <doc_name>_entities.json for each document of (model, doc_name, json), in a folder for each model. Returns the number of files."""
    pretty = F.to_json(F.from_json("json", "entities array<struct<text:string,label:string>>"), {"pretty": "true", "ignoreNullFields": "false"})
    return _export(documents.select(F.concat("model", F.lit("/"), "doc_name", F.lit("_entities.json")).alias("name"), pretty.cast("binary").alias("data")), path)


def export_text_files(docs: DataFrame, path: str) -> int:
    """One file for each row of (file_name, text). Returns the number of files."""
    return _export(docs.select(F.col("file_name").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("data")), path)


def write_table(wide: DataFrame, path: str) -> None:
    """A wide table, a folder for each model."""
    wide.write.mode("overwrite").partitionBy("model").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays must have been joined before."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_html(page: DataFrame, path: str) -> None:
    """A one-row report; write_pieces() is for reports of any size."""
    page.select("html").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


#: Bytes that are copied at a time where parts are joined.
COPY = 8 << 20


def write_pieces(pieces: DataFrame, path: str) -> str:
    """One file path/part-00000.html of the texts of (place, base, piece), in that order and without separators. Returns its name.

    Pieces are dealt out by ranges of their order; each task writes its range as a part, piece by piece. The parts are then
    joined by the file system where it can (HDFS does so without moving bytes), else by a task that copies them through a
    buffer. So no task and no driver holds the whole. A part gets its name when it is whole, so a task that is tried again
    does no harm.
    """
    spark = pieces.sparkSession
    uri = uri_of(spark, path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p(path), True)
    fs.mkdirs(p(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, root = pafs.FileSystem.from_uri(uri)
        context = TaskContext.get()
        name, size = f"{root}/_{context.partitionId():08d}", 0
        with store.open_output_stream(f"{name}-{context.taskAttemptId()}", compression=None) as out:
            for batch in batches:
                for piece in batch.column(0).to_pylist():
                    data = piece.encode()
                    out.write(data)
                    size += len(data)
        store.move(f"{name}-{context.taskAttemptId()}", f"{name}.part")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.part"]), pa.array([size], pa.int64())], ["name", "size"])

    ordered = pieces.repartitionByRange("place", "base").sortWithinPartitions("place", "base").select("piece")
    parts = sorted((r.name, r.size) for r in ordered.mapInArrow(run, "name string, size long").collect())  # a row for each part
    whole = f"{path.rstrip('/')}/part-00000.html"
    names = [f"{path.rstrip('/')}/{n.rpartition('/')[2]}" for n, size in parts if size]
    if fs.getScheme() == "hdfs" and len(names) > 1:
        sources = spark.sparkContext._gateway.new_array(p, len(names) - 1)
        for i, n in enumerate(names[1:]):
            sources[i] = p(n)
        fs.concat(p(names[0]), sources)
        fs.rename(p(names[0]), p(whole))
    else:
        sources = [n for n, size in parts if size]

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.fs as pafs

            for batch in batches:
                store, root = pafs.FileSystem.from_uri(uri)
                at = f"{root}/_whole-{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(at, compression=None) as out:
                    for n in sources:
                        with store.open_input_stream(n) as part:
                            while data := part.read(COPY):
                                out.write(data)
                store.move(at, f"{root}/part-00000.html")
                yield batch

        spark.range(1).coalesce(1).mapInArrow(join, "id long").collect()
    for n, _ in parts:
        fs.delete(p(f"{path.rstrip('/')}/{n.rpartition('/')[2]}"), False)
    return whole
