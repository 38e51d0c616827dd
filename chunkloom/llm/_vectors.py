"""Columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for vectors without null or non-finite components that are not all zero."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def most_common_dimension(rows: DataFrame, column: str) -> tuple[int, int]:
    """(dimension, rows) of the vectors' most common dimension; (0, 0) of an empty table."""
    found = rows.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return (found["d"], found["n"]) if found else (0, 0)


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
