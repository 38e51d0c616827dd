"""Consecutive numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of one key that one task sums.
KEY_ROWS = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own only in local mode where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    # files of frames that nothing refers to any more are deleted with them; a session that sets this otherwise has its way
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _ordered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in the order of ``order``, range-partitioned, sorted and checkpointed, with each row's __partition and __place there.

    Rows that are equal in ``order`` are told apart by where they were, so that many of them spread over partitions.
    """
    order = (*order, "__own")
    rows = df.withColumn("__own", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return checkpointed(rows.drop("__own")).select("*", F.shiftright(place, 33).alias("__partition"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))


def row_numbers(df: DataFrame, *order: str | Column, name: str = "row") -> DataFrame:
    """Adds each row's place, from 0, in the order of ``order``; only one count for each partition reaches the driver."""
    rows = _ordered(df, *order)
    firsts, total = [], 0
    for r in sorted(rows.groupBy("__partition").agg(F.count("*").alias("n")).collect()):
        firsts.append((r["__partition"], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(firsts, "__partition long, __first long")
    return rows.join(F.broadcast(starts), "__partition").withColumn(name, F.col("__first") + F.col("__place")).drop("__partition", "__place", "__first")


def until(df: DataFrame, amount: Column, most: int, *order: str | Column) -> DataFrame:
    """The rows of ``df``, in the order of ``order``, up to and with the first that makes the sum of ``amount`` (0 or more) exceed ``most``.

    One sum for each partition reaches the driver; running sums are taken only within the one partition at which the sum passes ``most``.
    """
    rows = _ordered(df.withColumn("__amount", F.coalesce(amount.cast("long"), F.lit(0).cast("long"))), *order)
    whole, total, passing = -1, 0, -1
    for r in sorted(rows.groupBy("__partition").agg(F.sum("__amount").alias("n")).collect()):
        if total + r["n"] > most:
            passing = r["__partition"]
            break
        whole, total = r["__partition"], total + r["n"]
    before = Window.partitionBy("__partition").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.filter(F.col("__partition") == passing).withColumn("__before", F.coalesce(F.sum("__amount").over(before), F.lit(0)) + total)
    kept = rows.filter(F.col("__partition") <= whole).unionByName(part.filter(F.col("__before") <= most).drop("__before"))
    return kept.select(*df.columns)


def running_sums(df: DataFrame, amount: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows of the same ``keys`` that come before, in the order of ``order``; 0 for the first.

    Where no key has more than KEY_ROWS rows each key is summed in a task. Else a key's rows may fill any number of partitions: of each
    partition its sum, its first and last key and where the last one starts reach the driver. Keys must not be null.
    """
    spark = df.sparkSession
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= KEY_ROWS:
        of_key = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(amount.cast("long")).over(of_key), F.lit(0).cast("long")))
    rows = _ordered(df.withColumn("__amount", F.coalesce(amount.cast("long"), F.lit(0).cast("long"))), *keys, *order)
    along = Window.partitionBy("__partition").orderBy("__place")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*keys)
    rows = rows.withColumn("__local", F.coalesce(F.sum("__amount").over(before), F.lit(0).cast("long"))).withColumn("__new", ~F.coalesce(F.lag(key).over(along) == key, F.lit(False)))
    rows = rows.withColumn("__begin", F.last(F.when(F.col("__new"), F.col("__local")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__first", F.count_if("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    ends = rows.groupBy("__partition").agg(F.min_by(key, "__place").alias("first"), F.max_by(key, "__place").alias("last"), F.max_by("__begin", "__place").alias("begin"), F.sum("__amount").alias("n"))
    carried, total, last, start = [], 0, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["__partition"]):
        goes_on = r["first"] == last
        carried.append((r["__partition"], total - start if goes_on else 0))  # what the first key has from the partitions before
        if not (goes_on and r["last"] == r["first"]):
            start = total + r["begin"]
        last, total = r["last"], total + r["n"]
    marks = spark.createDataFrame(carried, "__partition long, __carried long")
    rows = rows.join(F.broadcast(marks), "__partition")
    return rows.select(*df.columns, (F.col("__local") - F.col("__begin") + F.when(F.col("__first"), F.col("__carried")).otherwise(0)).alias(name))


def batches(df: DataFrame, size: int, *order: str | Column, name: str = "batch") -> DataFrame:
    """Adds the number of the batch of ``size`` rows to which each row belongs."""
    return row_numbers(df, *order, name="__row").withColumn(name, F.floor(F.col("__row") / size)).drop("__row")
