"""Embedded chunks: incremental embedding, lookups, similarity search and its relaxation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import dot, has_text, norm
from ..schema import CHUNK_COLUMNS
from . import vector_search

#: An embedder: texts -> one vector each. Called in the executors, on batches.
Embedder = Callable[[list[str]], list[list[float]]]
#: Rows that one call of an embedder gets.
BATCH = 50

# How a search without valid result is relaxed, and where searches start.
WIDER, MOST_RESULTS, LOWER, LEAST_SCORE = 2, 16, 0.05, 0.5
ASK_START, CONTEXT_START = (8, 0.85), (20, 0.75)


def hashing_embedder(dimension: int = 64) -> Embedder:
    """A deterministic stand-in for a model: hashed words, signed, normalised."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dimension)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1 if h >> 63 else -1
            length = np.linalg.norm(v)
            out.append((v / length if length else np.eye(1, dimension)[0]).tolist())
        return out

    return embed


def new_chunks(chunks: DataFrame, store: DataFrame | None) -> DataFrame:
    """Chunks with text whose id the store does not hold yet."""
    chunks = chunks.filter(has_text(F.col("content")))
    return chunks if store is None else chunks.join(store.select("id").distinct(), "id", "left_anti").select(*chunks.columns)


def embedded(chunks: DataFrame, embedder: Embedder, batch: int = BATCH, column: str = "content") -> DataFrame:
    """Adds ``embedding``; a batch whose embedder fails has null there and the reason in ``embed_error``."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                try:
                    part["embedding"], part["embed_error"] = embedder(part[column].tolist()), None
                except Exception as e:
                    part["embedding"], part["embed_error"] = None, str(e)
                yield part

    return chunks.mapInPandas(run, schema)


def find_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("id") == chunk_id)


def find_by_metadata(chunks: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Chunks whose metadata has all the wanted entries; none if nothing is wanted."""
    if not wanted:
        return chunks.limit(0)
    return chunks.filter(reduce(Column.__and__, (F.col("metadata")[k] == v for k, v in wanted.items())))


def similar(vectors: DataFrame, query: list[float], k: int, min_score: float, key: str = "id", digits: int | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``query`` with a relevance of at least ``min_score``, nearest first, ties by ``key``."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = (1 + dot(F.col("embedding"), q) / (norm(F.col("embedding")) * float(np.linalg.norm(np.asarray(query, float))))) / 2
    score = score if digits is None else F.round(score, digits)
    return vectors.withColumn("score", score).filter(F.col("score") >= min_score).orderBy(F.desc("score"), key).limit(k)


def similar_per_query(vectors: DataFrame, queries: DataFrame, k: int, min_score: float, key: str = "id", digits: int | None = None) -> DataFrame:
    """(query_id, key, score, rank) for each of ``queries`` (query_id, embedding): ``similar`` for all of them in one pass."""
    return vector_search.nearest(vectors, queries, k, min_score, key, digits)


def ladder(max_result: int, min_score: float) -> list[tuple[int, int, float]]:
    """(level, max_result, min_score) of the searches tried one after the other."""
    out = []
    while min_score >= LEAST_SCORE:
        out.append((len(out), max_result, min_score))
        if max_result < MOST_RESULTS:
            max_result += WIDER
        else:
            min_score -= LOWER
    return out


def first_valid_level(scored: DataFrame, start: tuple[int, float], least_hits: int = 1) -> DataFrame:
    """(query_id, level, max_result, min_score, hits): the first search of the ladder that finds ``least_hits``.

    ``scored`` is one search at the ladder's loosest level, (query_id, score, rank); no level is searched again.
    Queries that no level satisfies have no row.
    """
    levels = scored.sparkSession.createDataFrame(ladder(*start), "level int, max_result int, min_score double")
    met = scored.join(F.broadcast(levels), (F.col("rank") <= F.col("max_result")) & (F.col("score") >= F.col("min_score")))
    met = met.groupBy("query_id", "level", "max_result", "min_score").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least_hits)
    best = met.groupBy("query_id").agg(F.min(F.struct("level", "max_result", "min_score", "hits")).alias("b"))
    return best.select("query_id", "b.*")


def complete_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """All parts of the units of which any part was hit."""
    return chunks.join(hits.select("id").distinct(), "id", "left_semi")


def with_prefetched(prefetched: DataFrame, found: DataFrame) -> DataFrame:
    """Both, each part of a unit once."""
    return prefetched.select(*CHUNK_COLUMNS).unionByName(found.select(*CHUNK_COLUMNS)).dropDuplicates(["id", "part"])
