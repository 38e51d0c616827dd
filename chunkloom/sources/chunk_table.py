"""A table of chunks in buckets by id, so that what works on whole units does not shuffle it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(chunks: DataFrame, name: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write ``chunks`` as the table ``name``, all parts of an id in one bucket, in order; returns the table.

    ``combine``, ``unsplit``, ``complete_hits`` and parents' lookups then read each bucket where it lies. The number of ``buckets``
    is that of shuffle partitions unless given; take one for each some hundred MB of text.
    """
    spark = chunks.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = chunks.repartition(buckets, F.col("id")).write.mode("overwrite").format("parquet").bucketBy(buckets, "id").sortBy("id", "part")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)
