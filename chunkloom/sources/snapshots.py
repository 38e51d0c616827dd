"""States of a folder: which files are new, changed, gone or as they were since the last run, without reading those that look untouched."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import checkpointed
from .files import contents, uri_of, walk

STATE = "path string, length long, modified timestamp, digest string"
ADDED, CHANGED, REMOVED, SAME = "added", "changed", "removed", "same"


class FolderLog:
    """The states of a folder that runs have written below ``path``, numbered; the last one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        own = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = own.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(own)] if fs.exists(own) else []
        return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def state(self) -> DataFrame:
        """(path, length, modified, digest) of the files at the last run; none before the first."""
        versions = self._versions()
        return self.spark.read.schema(STATE).parquet(f"{self.path}/{versions[-1]:012}") if versions else self.spark.createDataFrame([], STATE)

    def write(self, compared: DataFrame) -> None:
        """Make what ``changes`` has found the last state. To be called when all that follows from it is done: a run that fails before is repeated."""
        number = (self._versions() or [-1])[-1] + 1
        compared.filter(F.col("change") != REMOVED).select("path", "length", "modified", "digest").write.mode("overwrite").parquet(f"{self.path}/{number:012}")


def changes(spark: SparkSession, root: str, log: FolderLog) -> DataFrame:
    """(path, length, modified, digest, change) of every file below ``root`` now or at the last run; paths are those below ``root``.

    A file of the same length and time is taken to be the same; others are read, by the executors, and are the same if their bytes are.
    """
    top = uri_of(spark, root)
    below = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:///"), f"^{re.escape(top)}/", "")
    now = walk(spark, root).select(below.alias("path"), "length", F.col("modificationTime").alias("modified"))
    before = log.state().select("path", F.col("length").alias("__length"), F.col("modified").alias("__modified"), F.col("digest").alias("__digest"))
    both = checkpointed(now.join(before, "path", "full"))
    untouched = F.coalesce((F.col("length") == F.col("__length")) & (F.col("modified") == F.col("__modified")), F.lit(False))
    seen = both.filter("length is not null")
    read = seen.filter(~untouched)
    digests = read.join(contents(read.select("path"), root).select("path", F.sha2("content", 256).alias("digest")), "path")
    change = F.when(F.col("__length").isNull(), ADDED).when(F.col("digest") == F.col("__digest"), SAME).otherwise(CHANGED)
    found = digests.select("path", "length", "modified", "digest", change.alias("change"))
    found = found.unionByName(seen.filter(untouched).select("path", "length", "modified", F.col("__digest").alias("digest"), F.lit(SAME).alias("change")))
    gone = both.filter("length is null").select("path", "length", "modified", F.col("__digest").alias("digest"), F.lit(REMOVED).alias("change"))
    return checkpointed(found.unionByName(gone))
