"""Chunks as flat string maps, and builders of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CHUNK_COLUMNS

#: Starts every key of a flat map; dynamic entries have "metadata." after it.
KEY_PREFIX = "chunk_"
_FLAT = [c for c in CHUNK_COLUMNS if c not in ("metadata", "content")]
_NUMBERS = ("part", "total", "size", "overlap")


def flat_map(prefix: str = KEY_PREFIX) -> Column:
    """A chunk's attributes but its content as map<string,string>; null ones are left out."""
    fixed = F.create_map(*(x for c in _FLAT for x in (F.lit(prefix + c), F.col(c).cast("string"))))
    dynamic = F.transform_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit(f"{prefix}metadata."), k))
    return F.map_filter(F.map_concat(fixed, dynamic), lambda _, v: v.isNotNull())


def chunk_from_map(flat: str, content: str, prefix: str = KEY_PREFIX) -> list[Column]:
    """The columns of a chunk from its flat map and content; numbers that are missing are 0; a missing id fails."""
    own = F.col(flat)
    columns = {c: F.try_element_at(own, F.lit(prefix + c)) for c in _FLAT}
    columns["id"] = F.coalesce(columns["id"], F.raise_error(F.lit("a chunk's map needs an id")).cast("string"))
    for c in _NUMBERS:
        columns[c] = F.coalesce(columns[c].cast("int"), F.lit(0))
    start = f"{prefix}metadata."
    dynamic = F.map_filter(own, lambda k, v: k.startswith(start) & v.isNotNull())
    columns["metadata"] = F.transform_keys(dynamic, lambda k, _: F.substring(k, len(start) + 1, F.length(k)))
    columns["content"] = F.col(content)
    return [columns[c].alias(c) for c in CHUNK_COLUMNS]


def chunk_columns(**given: Column) -> list[Column]:
    """The columns of a chunk, those not given null, zero or empty; size is the content's length unless given."""
    defaults = {c: F.lit(None).cast("string") for c in CHUNK_COLUMNS} | {c: F.lit(0) for c in _NUMBERS} | {"metadata": F.create_map().cast("map<string,string>")}
    if "content" in given:
        defaults["size"] = F.coalesce(F.length(given["content"]), F.lit(0))
    return [(given.get(c, defaults[c])).alias(c) for c in CHUNK_COLUMNS]


def to_segments(chunks: DataFrame, prefix: str = KEY_PREFIX) -> DataFrame:
    """(text, metadata): what an embedder and a vector store take."""
    return chunks.select(F.col("content").alias("text"), flat_map(prefix).alias("metadata"))


def from_segments(segments: DataFrame, prefix: str = KEY_PREFIX) -> DataFrame:
    return segments.select(*chunk_from_map("metadata", "text", prefix))
