"""The library's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunking, linking, searching

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = chunking.QUERIES | linking.QUERIES | searching.QUERIES
ORACLE_SQL: dict[str, str] = chunking.ORACLE_SQL | linking.ORACLE_SQL | searching.ORACLE_SQL
