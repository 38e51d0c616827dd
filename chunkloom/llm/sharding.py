"""Contiguous shards of near equal bytes, from global prefix sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed, table


def shard_by_bytes(docs: DataFrame, shards: int = 16, whole: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``, and with ``whole`` the row itself as a struct ``doc``.

    Rows are ordered by doc_id (null first), then by checksum and size; a row's size is its text's UTF-8
    bytes (null: none) plus 1. Each partition's total gives its first byte's place; a row goes to
    the shard in which its middle byte lies when all bytes are cut at equal targets, so a shard
    differs from its target by one row at most. slot counts a shard's rows from 0. Rows that repeat
    are all kept, each with its own slot, and may lie in several partitions; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *kept)
    order = ("doc_id", "text_crc32", "size", "own")
    rows = rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = checkpointed(rows.drop("own"))
    totals = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("size").alias("bytes")).collect()
    before, total = {}, 0
    for part, size in sorted((r["part"], r["bytes"]) for r in totals):
        before[part] = total
        total += size

    def placed(batches):
        at = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            ends = at + np.cumsum(sizes)
            middle = (ends - sizes).astype(object) * 2 + sizes if total > 1 << 57 else 2 * ends - sizes
            yield batch, (middle * shards // (2 * total)).astype(np.int64)
            at = int(ends[-1]) if len(ends) else at

    def count(batches):
        part, counts = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for _, own in placed(batches):
            counts += np.bincount(own, minlength=shards)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(counts[used])], ["part", "shard", "n"])

    firsts: dict[int, dict[int, int]] = {}
    seen = [0] * shards
    for r in sorted(rows.select("doc_id", "size").mapInArrow(count, "part int, shard int, n long").collect()):
        firsts.setdefault(r["part"], {})[r["shard"]] = seen[r["shard"]]
        seen[r["shard"]] += r["n"]

    def assign(batches):
        used = dict(firsts.get(TaskContext.get().partitionId(), {}))
        for batch, own in placed(batches):
            slots = np.zeros(len(own), np.int64)
            for shard in np.unique(own).tolist():
                here = own == shard
                slots[here] = used[shard] + np.arange(here.sum())
                used[shard] += int(here.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(slots)], [*batch.schema.names, "shard", "slot"])

    return rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write ``docs`` to ``path``, one folder for each shard, rows in order of their slots within a file.

    The columns shard and slot are the new ones; columns of ``docs`` with these names are left out.
    """
    placed = shard_by_bytes(docs, shards, whole=True)
    rows = placed.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")
    rows.repartition("shard", F.shiftright("slot", 20)).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op8_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
