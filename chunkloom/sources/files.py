"""Scans of folders of text files. Files without a byte hold nothing to take and are not listed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import checkpointed
from ..operators.vetoes import Veto, allowed, standard_vetoes, unprocessed


#: Bytes of contents, about, and names that a task hands on at once.
BATCH_BYTES, NAMES = 1 << 20, 10_000


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as its file system names it, and as the paths of Spark's readers start."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def uri_of(spark: SparkSession, root: str) -> str:
    """``root`` as its file system names it, in the form that pyarrow's file systems take."""
    return re.sub(r"^file:/+", "file:///", qualified(spark, root)).rstrip("/")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri``, as ``uri_of`` gives it, and the path there."""
    return (pafs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file:///") else pafs.FileSystem.from_uri(uri)


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` over all tasks, however small they are: what is done for each takes longer than its bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def _listable(spark: SparkSession, root: str) -> bool:
    """True if ``root`` is a folder that executors can list: one folder, in a store that pyarrow's file systems reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        return fs.exists(path) and fs.getFileStatus(path).isDirectory() and opened(uri_of(spark, root)) is not None
    except (pa.ArrowInvalid, OSError, ImportError):
        return False


def walk(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of all files below ``root``; contents are not read.

    Executors list the folders, one level of them after the other, so that the driver holds no names. Names that start with "_" or "." are left
    out, as Spark's readers do. Where executors cannot list ``root`` Spark's reader does, on the driver.
    """
    if pattern or not _listable(spark, root):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        return reader.load(root).select("path", "length", "modificationTime")
    top = uri_of(spark, root)
    base = qualified(spark, root)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, start = opened(top)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = fs.get_file_info(pafs.FileSelector(f"{start.rstrip('/')}/{folder}", allow_not_found=True))
                for a in range(0, len(found), NAMES):
                    some = [x for x in found[a : a + NAMES] if x.type in (pafs.FileType.File, pafs.FileType.Directory) and not _left_out(x.base_name, not x.is_file)]
                    below = pa.array([f"{folder}/{x.base_name}" if folder else x.base_name for x in some], pa.string())
                    lengths = pa.array([x.size if x.is_file else None for x in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([below, lengths, pa.array([(x.mtime_ns or 0) // 1_000_000 for x in some], pa.int64())], ["below", "length", "ms"])

    folders, files = spark.createDataFrame([("",)], "below string"), []
    while not folders.isEmpty():
        found = checkpointed(_dealt(folders, "below").mapInArrow(listed, "below string, length long, ms long"))
        files.append(found.filter("length > 0"))
        folders = found.filter("length is null").select("below")
    return reduce(DataFrame.unionByName, files).select(F.concat(F.lit(f"{base}/"), "below").alias("path"), "length", F.timestamp_millis("ms").alias("modificationTime"))


def _left_out(name: str, folder: bool) -> bool:
    """What Spark's readers leave out."""
    out = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    return out and not (folder and name.startswith(("_metadata", "_common_metadata")))


def contents(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path and others) with content: the bytes of each path below ``root``; a file that has gone meanwhile has no row."""
    top = uri_of(files.sparkSession, root)
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])
    at = files.columns.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, start = opened(top)
        for batch in batches:
            rows, texts, size = [], [], 0
            for row, path in enumerate(batch.column(at).to_pylist()):  # few bytes at a time: files may be long
                try:
                    with fs.open_input_stream(f"{start.rstrip('/')}/{path}") as f:
                        texts.append(f.read())
                except FileNotFoundError:
                    continue
                rows.append(row)
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(texts, pa.binary())], schema.names)
                    rows, texts, size = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(texts, pa.binary())], schema.names)

    return _dealt(files, "path").mapInArrow(read, schema)


def source_files(spark: SparkSession, root: str, vetoes: list[Veto] | None = None, pattern: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """(path, length, content) of the files that no veto keeps out, as UTF-8 text; each path once.

    The predicates see the path below ``root``; contents are read only for the files that stay, by the executors.
    """
    by_tasks = not pattern and _listable(spark, root)
    if by_tasks:
        files = walk(spark, root)
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        files = reader.load(root).select("path", "length", F.col("content"))
    below = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    files = files.withColumn("__below", F.when(below.startswith(base), F.substring(below, len(base) + 1, F.length(below))).otherwise(below))
    files = allowed(files, standard_vetoes() if vetoes is None else vetoes, path="__below").drop("__below")
    if not by_tasks:
        return unprocessed(files, done).select("path", "length", F.decode("content", "UTF-8").alias("content"))
    files = unprocessed(files.select("path", "length"), done)
    read = contents(files.withColumns({"__path": F.col("path"), "path": F.substring("path", len(qualified(spark, root)) + 2, 1 << 30)}), root)
    return read.select(F.col("__path").alias("path"), "length", F.decode("content", "UTF-8").alias("content"))


def text_lines(spark: SparkSession, path: str | None, stdin=None) -> DataFrame:
    """(value) lines of a text file; of standard input where the path is missing, empty or a dash."""
    if path in (None, "", "-"):
        import sys

        lines = [(x.rstrip("\n"),) for x in (stdin or sys.stdin)]
        return spark.createDataFrame(lines, "value string")
    return spark.read.text(path)
