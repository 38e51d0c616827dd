"""Nearest vectors of many queries at once: by a scan, or in a store of clusters of which a search reads only those that it must.

Relevance is the cosine, moved to 0..1. Vectors that are null, zero, of another length than the query or that hold null or
components that are not finite are not compared, and neither are rows without key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import checkpointed

#: Queries broadcast at once, and compared at once with vectors; a store of clusters takes more in turns, a scan by meeting them in groups.
QUERY_BLOCK = 1000
#: Components of the vectors and of the queries of one group, about, and blocks of queries that are wanted, so that all cores have work.
SLICE, ASKED, LEAST_BLOCKS = 1 << 23, 1 << 20, 32
#: Vectors that clusters are fitted on, at most, and clusters of a store, at most.
SAMPLE, MOST_CENTRES = 1 << 15, 1 << 12
#: Parts into which the rows of one cluster are dealt when they are written, so that a large one is not one task.
SALTS = 8
#: What rounding can add to a score or an angle that is computed in another order.
_SLACK = 1e-7


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, vectors, norms) of the usable vectors of ``column``."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    vectors = flat.fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(len(at), width)
    norms = np.sqrt(np.sum(vectors * vectors, axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return at[good], vectors[good], norms[good]


class _Best:
    """The best ``k`` (score, key) of every query of a block, over the batches of a partition."""

    def __init__(self, queries: np.ndarray, k: int, least: np.ndarray, digits: int | None):
        self.queries, self.norms = queries, np.sqrt(np.sum(queries * queries, axis=1))
        self.unit = queries / self.norms[:, None]
        self.k, self.least, self.digits = k, least.copy(), digits
        self.loose = _SLACK if digits is None else 10.0**-digits
        self.kept: list[list[tuple]] = [[] for _ in queries]

    def add(self, keys: pa.Array, vectors: np.ndarray, norms: np.ndarray, own: np.ndarray) -> None:
        """Compare ``vectors`` with the queries ``own``."""
        cosines = self.unit[own] @ (vectors / norms[:, None]).T
        for row in np.flatnonzero((1 + cosines.max(axis=1, initial=-1)) / 2 >= self.least[own] - self.loose):
            q, near = own[row], (1 + cosines[row]) / 2
            at = np.flatnonzero(near >= self.least[q] - self.loose)
            if len(at) > self.k:
                kth = np.partition(near[at], -self.k)[-self.k]
                at = at[near[at] >= kth - 2 * self.loose]
            # each score anew, in one order of addition, so that equal vectors score alike
            score = (1 + np.sum(vectors[at] * self.queries[q], axis=1) / (norms[at] * self.norms[q])) / 2
            score = score if self.digits is None else np.round(score, self.digits)
            enough = score >= self.least[q]
            found = self.kept[q] + [(-s, key) for s, key in zip(score[enough].tolist(), keys.take(pa.array(at[enough])).to_pylist(), strict=True)]
            found.sort()
            self.kept[q] = found[: self.k]
            if len(self.kept[q]) == self.k:
                self.least[q] = max(self.least[q], -self.kept[q][-1][0])

    def batch(self, names: list, key: pa.DataType, query: pa.DataType) -> pa.RecordBatch:
        rows = [(names[q], k, -s) for q, found in enumerate(self.kept) for s, k in found]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], query), pa.array([r[1] for r in rows], key), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "key", "score"])


def _compared(rows: DataFrame, names: list, matrix: np.ndarray, kind: str, k: int, least: np.ndarray, digits: int | None, lists: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(query_id, key, score): each partition's best of ``rows`` (key, vector, centre).

    With ``lists`` (centre -> queries) a row meets only the queries that its centre is listed for.
    """
    shared = rows.sparkSession.sparkContext.broadcast((names, matrix, least, lists))
    key = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, least, lists = shared.value
        best, all_, key_type = _Best(matrix, k, least, digits), np.arange(len(matrix)), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
                at, vectors, norms = _matrix(part.column(1), matrix.shape[1])
                keys = part.column(0).take(pa.array(at))
                if lists is None:
                    best.add(keys, vectors, norms, all_)
                    continue
                centre = part.column(2).to_numpy(zero_copy_only=False)[at]
                for c in np.unique(centre).tolist():
                    own = np.flatnonzero(centre == c)
                    if c in lists:
                        best.add(keys.take(pa.array(own)), vectors[own], norms[own], lists[c])
        if key_type is not None:
            yield best.batch(names, key_type, pa.array(names[:1]).type if kind == "string" else pa.int64() if kind == "bigint" else pa.int32())

    return rows.mapInArrow(run, f"query_id {kind}, key {key}, score double")


def _ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("key", key)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.filter("query_id is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _in_groups(rows: DataFrame, asked: DataFrame, k: int, min_score: float, digits: int | None) -> DataFrame:
    """(query_id, key, score): the best of ``rows`` (key, embedding) for ``asked`` (query_id, embedding), of each slice of the rows.

    Blocks of queries and slices of vectors meet in groups, one of each; none passes the driver, and a group's bytes are bounded.
    """
    rows, asked = checkpointed(rows), checkpointed(asked)
    n, width = asked.agg(F.count("*"), F.sum(F.coalesce(F.size("embedding"), F.lit(0)).cast("long"))).first()
    blocks = max(1, -(-width // ASKED), min(LEAST_BLOCKS, -(-n // QUERY_BLOCK)))
    slices = max(1, -(-(rows.agg(F.sum(F.coalesce(F.size("embedding"), F.lit(0)).cast("long"))).first()[0] or 0) // SLICE))

    def dealt(side: DataFrame, own: str, n: int, other: str, times: int) -> DataFrame:
        """``side`` dealt into ``n`` and each of these repeated for all the others."""
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
        return side.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    left, right = dealt(asked, "block", blocks, "slice", slices), dealt(rows, "slice", slices, "block", blocks)
    kinds = left.schema["query_id"].dataType.simpleString(), right.schema["key"].dataType.simpleString()

    def compare(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return pa.table({})
        key, query = rows.schema.field("key").type, asked.schema.field("query_id").type
        names, vectors = asked.column("query_id").combine_chunks(), asked.column("embedding").combine_chunks()
        keys, stored = rows.column("key").combine_chunks(), rows.column("embedding").combine_chunks()
        out = [pa.RecordBatch.from_arrays([pa.array([], query), pa.array([], key), pa.array([], pa.float64())], ["query_id", "key", "score"])]
        for width in sorted({w for w in vectors.value_lengths().to_pylist() if w}):
            at, matrix, _ = _matrix(vectors, width)
            there, compared, norms = _matrix(stored, width)
            own = keys.take(pa.array(there))
            for a in range(0, len(at), QUERY_BLOCK):
                part = matrix[a : a + QUERY_BLOCK]
                best, all_ = _Best(part, k, np.full(len(part), min_score), digits), np.arange(len(part))
                for b in range(0, len(there), 4096):
                    best.add(own.slice(b, 4096), compared[b : b + 4096], norms[b : b + 4096], all_)
                out.append(best.batch(names.take(pa.array(at[a : a + QUERY_BLOCK])).to_pylist(), key, query))
        return pa.Table.from_batches(out)

    groups = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice"))
    return groups.applyInArrow(compare, f"query_id {kinds[0]}, key {kinds[1]}, score double")


def _blocks(queries: DataFrame, few: pa.Table | None = None) -> Iterator[tuple[list, np.ndarray]]:
    """(query_ids, vectors) of at most about QUERY_BLOCK queries at a time; ``few`` are the first QUERY_BLOCK + 1 of them, if these are known."""
    rows = _asked(queries)
    few, blocks = rows.limit(QUERY_BLOCK + 1).toArrow() if few is None else few, 1
    if few.num_rows > QUERY_BLOCK:
        rows = checkpointed(rows)
        blocks = -(-rows.count() // QUERY_BLOCK)
    for b in range(blocks):
        own = (few if blocks == 1 else rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()).combine_chunks()
        widths = {n for n in own.column("embedding").combine_chunks().value_lengths().to_pylist() if n}
        for width in sorted(widths):
            at, vectors, _ = _matrix(own.column("embedding").combine_chunks(), width)
            if len(at):
                yield own.column("query_id").take(pa.array(at)).to_pylist(), vectors


def _nothing(vectors: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    return vectors.sparkSession.createDataFrame([], f"query_id {kinds[0]}, key {kinds[1]}, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, min_score: float, key: str = "id", digits: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` rows nearest to each of ``queries`` (query_id, embedding), of a relevance of ``min_score`` at least.

    Ties go to the smaller ``key``. ``digits`` rounds scores before they are compared. Every row of ``vectors`` meets every
    query, as the task asks: up to QUERY_BLOCK queries are broadcast to one pass, and a partition gives its ``k`` best of each; more meet the
    vectors in groups of a shuffle, in one plan whatever their number.
    """
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), "embedding")
    few = _asked(queries).limit(QUERY_BLOCK + 1).toArrow()
    if few.num_rows > QUERY_BLOCK:
        return _ranked(_in_groups(rows, _asked(queries), k, min_score, digits), k, key)
    out = _nothing(vectors, queries, key)
    kind = queries.schema["query_id"].dataType.simpleString()
    for names, matrix in _blocks(queries, few):
        out = out.unionByName(_compared(rows, names, matrix, kind, k, np.full(len(names), min_score), digits))
    return _ranked(out, k, key)


class VectorStore:
    """Vectors in folders by their nearest centre, with the widest angle of each folder.

    A search knows from a centre's angle to the query and the folder's widest angle the best score that the folder can hold. It
    reads the nearest folders first, for the ``k``-th score, and then only those that can hold a better one: the result is the scan's.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path, key
        #: Folders read by each pass of the last search.
        self.folders_read: list[int] = []

    def create(self, vectors: DataFrame, centres: int | None = None, rounds: int = 10) -> None:
        """Fit centres on a bounded sample of ``vectors``, write them and add all rows."""
        rows = vectors.filter(F.col("embedding").isNotNull())
        total = rows.count()
        place = F.shiftrightunsigned(F.xxhash64(F.lit(5), self.key), 1)
        drawn = rows if total <= SAMPLE else rows.filter(place < (1 << 63) * SAMPLE // total)  # about SAMPLE rows, without a sort
        column = drawn.select("embedding").limit(2 * SAMPLE).toArrow().column("embedding").combine_chunks()
        widths = [n for n in column.value_lengths().to_pylist() if n]
        _, sample, norms = _matrix(column, max(widths, key=widths.count)) if widths else (None, np.zeros((0, 1)), np.zeros(0))
        found = _centres(sample / norms[:, None], min(MOST_CENTRES, centres or math.isqrt(total) + 1), rounds)
        kind = vectors.schema[self.key].dataType.simpleString()
        self.spark.createDataFrame([(i, c.tolist(), kind) for i, c in enumerate(found)], "centre int, direction array<double>, kind string").write.parquet(f"{self.path}/centres")
        self.add(vectors)

    def _directions(self) -> tuple[np.ndarray, str]:
        """The centres and the type of keys."""
        rows = sorted(self.spark.read.parquet(f"{self.path}/centres").collect())
        return np.array([r["direction"] for r in rows]).reshape(len(rows), -1), rows[0]["kind"]

    def add(self, vectors: DataFrame) -> None:
        """Append rows (key, embedding) to the folders of their centres; those that cannot be compared are left out."""
        directions, kind = self._directions()
        shared = self.spark.sparkContext.broadcast(directions)
        rows = vectors.filter(F.col(self.key).isNotNull()).select(F.col(self.key).cast(kind).alias("key"), F.col("embedding").cast("array<float>").alias("embedding"))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in batches:
                at, vectors, norms = _matrix(batch.column(1), centres.shape[1])
                near = vectors / norms[:, None] @ centres.T
                own = near.argmax(axis=1) if len(at) else np.zeros(0, np.int64)
                angle = np.arccos(np.clip(near[np.arange(len(at)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(own, pa.int32()), pa.array(angle, pa.float64())], ["key", "embedding", "centre", "angle"])

        placed = checkpointed(rows.mapInArrow(assign, f"key {kind}, embedding array<float>, centre int, angle double"))
        dealt = placed.drop("angle").repartition(F.col("centre"), F.pmod(F.xxhash64("key"), F.lit(SALTS)))
        dealt.write.mode("append").partitionBy("centre").parquet(f"{self.path}/vectors")
        placed.groupBy("centre").agg(F.max("angle").alias("angle"), F.count("*").alias("rows")).write.mode("append").parquet(f"{self.path}/bounds")

    def search(self, queries: DataFrame, k: int, min_score: float, digits: int | None = None) -> DataFrame:
        """As ``nearest``."""
        self.folders_read = []
        directions, key_kind = self._directions()
        stored = self.spark.read.schema(f"key {key_kind}, embedding array<float>, centre int").parquet(f"{self.path}/vectors")
        out = _nothing(stored, queries, "key")
        kind = queries.schema["query_id"].dataType.simpleString()
        widest, held = {}, {}
        for r in self.spark.read.schema("centre int, angle double, rows long").parquet(f"{self.path}/bounds").groupBy("centre").agg(F.max("angle").alias("angle"), F.sum("rows").alias("n")).collect():
            widest[r["centre"]], held[r["centre"]] = r["angle"], r["n"]
        full = np.array(sorted(held), np.int64)
        angles, counts = np.array([widest[c] for c in full.tolist()]), np.array([held[c] for c in full.tolist()])
        for names, matrix in _blocks(queries):
            if not len(full) or matrix.shape[1] != directions.shape[1]:
                continue
            unit = matrix / np.sqrt(np.sum(matrix * matrix, axis=1))[:, None]
            away = np.arccos(np.clip(unit @ directions[full].T, -1, 1))
            order = np.argsort(away, axis=1, kind="stable")
            # nearest folders that hold k rows together
            enough = np.cumsum(counts[order], axis=1) - counts[order] < k
            first = np.zeros_like(enough)
            np.put_along_axis(first, order, enough, axis=1)
            least = np.full(len(names), min_score)
            near = checkpointed(self._read(stored, full, first, names, matrix, kind, k, least, digits))
            of_kth = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("r") == k)
            place = {n: i for i, n in enumerate(names)}
            for r in of_kth.select("query_id", "score").collect():  # one number for each query of the block
                least[place[r["query_id"]]] = max(min_score, r["score"])
            best = (1 + np.cos(np.maximum(0, away - angles - _SLACK))) / 2 + (_SLACK if digits is None else 10.0**-digits)
            more = (best >= least[:, None]) & ~first
            out = out.unionByName(near).unionByName(self._read(stored, full, more, names, matrix, kind, k, least, digits))
        return _ranked(out, k, self.key)

    def _read(self, stored: DataFrame, full: np.ndarray, wanted: np.ndarray, names: list, matrix: np.ndarray, kind: str, k: int, least: np.ndarray, digits: int | None) -> DataFrame:
        lists = {c: np.flatnonzero(own) for c, own in zip(full.tolist(), wanted.T, strict=True) if own.any()}
        self.folders_read.append(len(lists))
        rows = stored.filter(F.col("centre").isin(list(lists)))
        return _compared(rows, names, matrix, kind, k, least, digits, lists)


def _centres(sample: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Directions that the sample gathers around: spherical k-means from evenly drawn starts."""
    if not len(sample):
        return np.eye(1, sample.shape[1])
    centres = np.unique(sample, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(n, len(centres))).astype(int)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        some, begin = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], begin)
        lengths = np.linalg.norm(sums, axis=1)
        centres[some[lengths > 0]] = sums[lengths > 0] / lengths[lengths > 0, None]
    return centres
