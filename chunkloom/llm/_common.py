"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import checkpointed

#: Bytes of text that a model is fitted on, at most.
SAMPLE_BYTES = 1 << 26
WORD = r"[^\x20\x09-\x0D]+"
_U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and checkpoints of frames that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python workers at most ``rows`` at a time: batches are held by both sides at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def frugal(f):
    """``f`` for mapInArrow, which at the end of a partition gives what it has freed back to the system: workers live on."""

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every system's allocator has this call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def plan_bytes(df: DataFrame, otherwise: int = 1 << 30) -> int:
    """The optimiser's estimate of the bytes that ``df`` reads; ``otherwise`` if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else otherwise


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U64(27))
    h = h * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE_VALUES_LOWER = _BYTE_VALUES[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(1 << 20, n + 1)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_slices(texts: pa.Array, most: int = 1 << 20):
    """(first row, bytes, offsets) of consecutive slices of about ``most`` bytes; rows are never cut."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count or not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every row, A-Z lower-cased, and each row's first word (one more at the end)."""
    n, rows = len(data), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    powers, inverse = _powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES_LOWER[data] * powers[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, offsets, "left")


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's distinct shingles of ``width`` words, sorted; a shorter row with words is one shingle; else none."""
    n = len(words)
    factors = [_U64((2 * j + 1) * 0xD6E8FEB86659FD93 % (1 << 64)) for j in range(width)]
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j : n - width + 1 + j] * factors[j]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mixed(np.array([sum(int(w) * int(f) for w, f in zip(words[a:b], factors, strict=False)) + (b - a) & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b): the smallest id that it reaches.

    Large-star and small-star rounds, each an aggregate with map-side combining and a join
    on the vertex; no vertex's links are collected, and a vertex with many can be split by the join. Every round is
    checkpointed. Paths halve, at least, with each round or two; links that ``rounds`` do not settle are an error.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.union(below.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def numbered(df: DataFrame, *order: str | Column, name: str = "row") -> DataFrame:
    """``df`` with every row's place (from 0) in the order of the columns ``order``, by per-partition counts.

    Range-partitioned, sorted and checkpointed; only one count for each partition reaches the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (*order, "__own")
    rows = df.withColumn("__own", F.monotonically_increasing_id())  # equal rows may lie in several partitions
    rows = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__own"))
    at = F.monotonically_increasing_id()
    rows = rows.select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    counts = {r["__part"]: r["c"] for r in rows.groupBy("__part").agg(F.count("*").alias("c")).collect()}
    firsts, total = [], 0
    for part in sorted(counts):
        firsts.append((part, total))
        total += counts[part]
    starts = spark.createDataFrame(firsts, "__part long, __first long")
    return rows.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__first") + F.col("__at")).alias(name))


def least_hashed(rows: DataFrame, n: int, seed: int, *keys: str, total: int | None = None) -> DataFrame:
    """The ``n`` rows that a seeded hash of ``keys`` puts first (ties by the keys).

    What the hash cannot put among them is left out before the sort, so that the one task that merges reads few rows.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 1)
    total = rows.count() if total is None else total
    if total > 8 * n:
        near = rows.filter(place < (1 << 63) * 4 * n // total)
        if near.count() >= n:
            rows = near
    return rows.orderBy(place, *keys).limit(n)


def drawn(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Rows of the ``n`` values of ``key`` that a seeded hash puts first; only those values are broadcast."""
    ids = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    return rows.join(F.broadcast(least_hashed(ids, n, seed, key)), key)


def sample_table(rows: DataFrame, most: int = SAMPLE_BYTES) -> pa.Table:
    """A bounded number of ``rows`` (doc_id, text, ...), one for a doc_id at most, on the driver, in order of doc_id.

    In the order of a hash of doc_id, texts that would exceed ``most`` bytes together are left out.
    """
    rows = checkpointed(rows)
    sizes = rows.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    kept, left = [], most
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left:
            kept.append(r["doc_id"])
            left -= r["n"]
    return (rows if len(kept) == len(sizes) else rows.filter(F.col("doc_id").isin(kept))).toArrow().sort_by("doc_id")


def sliced(texts: pa.Array, most: int = 1 << 20):
    """(first row, texts) of slices of about ``most`` bytes."""
    for row, data, offsets in text_slices(texts, most):
        yield row, pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string as it is; null counts as empty."""
    strings = strings.cast(pa.large_string()).fill_null("")
    if not len(strings):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    powers, inverse = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
    return mixed((sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]] + _U64(1))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting: for many values faster than np.unique's hashing."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return values[first]
