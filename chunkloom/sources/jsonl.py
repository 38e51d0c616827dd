"""Chunks as JSON lines."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import path_from_source_root
from ..schema import CHUNK_COLUMNS, CHUNK_SCHEMA
from .files import uri_of


def to_lines(chunks: DataFrame) -> DataFrame:
    """(value): one JSON object for each chunk, nulls written."""
    return chunks.select(F.to_json(F.struct(*CHUNK_COLUMNS), {"ignoreNullFields": "false"}).alias("value"))


def parsed(line: Column, schema: T.StructType) -> Column:
    """A struct of ``schema`` and _corrupt_record, which is null where the line is a whole JSON object."""
    return F.from_json(line, T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt_record"})


def decode(lines: DataFrame, schema: T.StructType = CHUNK_SCHEMA, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the lines that can be read; blank and malformed ones are dropped, unknown properties ignored."""
    rows = lines.filter(F.col(column).rlike(r"\S")).withColumn("__row", parsed(F.col(column), schema))
    rows = rows.filter(F.col("__row").isNotNull() & F.col("__row._corrupt_record").isNull())
    return rows.select(*keep, *(F.col("__row")[f.name].alias(f.name) for f in schema.fields))


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.text(path))


def write(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    to_lines(chunks).write.mode(mode).text(path)


def load_by_id(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Chunks of a JSONL folder, all parts of a unit in one partition."""
    chunks = read(spark, path)
    return chunks.repartition(partitions, "id") if partitions else chunks.repartition("id")


def unwritten(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """The rows of ``files`` whose file does not exist below ``root`` yet, under its path from "src" on.

    Executors look the files up, all of a batch at once; ``root`` must be in a store that pyarrow's file systems reach.
    """
    uri = uri_of(files.sparkSession, root)

    @F.pandas_udf("boolean")
    def missing(below: pd.Series) -> pd.Series:
        fs, top = pafs.FileSystem.from_uri(uri)
        found = fs.get_file_info([f"{top}/{x}" for x in below])
        return pd.Series([x.type == pafs.FileType.NotFound for x in found], dtype=bool)

    return files.filter(missing(F.coalesce(path_from_source_root(F.col(path)), F.lit("/"))))


def write_sources(files: DataFrame, root: str) -> int:
    """Write (path, content) below ``root``, each under its path from "src" on; returns the number of files written.

    Files that exist are left as they are. Executors write their own rows, each file under another name first, so that a task
    which runs again leaves whole files.
    """
    uri = uri_of(files.sparkSession, root)

    def write(batches):
        fs, top = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{top}/{path}"
                part = f"{target.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(part) as out:
                    out.write((content or "").encode())
                fs.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = unwritten(files, root).select(path_from_source_root(F.col("path")).alias("path"), "content").filter("path is not null").dropDuplicates(["path"])
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
