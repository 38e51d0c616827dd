"""Maximum inner product search with score-aware anisotropic quantisation.

Vectors are product-quantised to four bits for each two dimensions. Codebooks and codes
minimise a loss in which the part of the residual that is parallel to the vector weighs more
than the rest, since that part moves large inner products. A query's tables of inner products
with the centres are added up along the codes of a block of vectors; the best of these are
reranked by their exact inner products, and so is every vector whose stored error of quantisation
lets it reach the last of them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpointed, frugal, least_hashed, numbered, table
from ._vectors import matrix, most_common_dimension, usable

#: Rows that codebooks are fitted on, at most; drawn by a hash of vec_id. Every row is indexed.
SAMPLE = 4096
#: Vectors in a block, queries that are broadcast at once, and queries whose tables are held at once.
VECTORS, QUERIES, TABLES = 8192, 4096, 64
#: Candidates of a block that are reranked first, for each neighbour asked for.
RERANK = 8
#: Share of the largest inner products that the loss cares for, as a cosine.
COSINE = 0.2


class Quantiser:
    """Four-bit product quantiser with an anisotropic loss."""

    def __init__(self, dimension: int, parallel: float | None = None, centres: np.ndarray | None = None):
        self.dimension, self.parts = dimension, -(-dimension // 4) * 2
        self.parallel = parallel or max(1.0, (dimension - 1) * COSINE**2 / (1 - COSINE**2))
        self.centres = centres

    def _split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * self.parts - self.dimension))).reshape(len(x), self.parts, 2)

    def assign(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (n, parts): coordinate descent on the anisotropic loss, starting from the nearest centres."""
        y, u = self._split(x), self._split(x / np.linalg.norm(x, axis=1, keepdims=True))
        codes = np.empty((len(x), self.parts), np.int64)
        along = np.empty((len(x), self.parts))
        for m in range(self.parts):
            e = y[:, m, None, :] - self.centres[m]
            codes[:, m] = (e**2).sum(axis=2).argmin(axis=1)
            along[:, m] = ((y[:, m] - self.centres[m][codes[:, m]]) * u[:, m]).sum(axis=1)
        total = along.sum(axis=1)
        for _ in range(passes):
            for m in range(self.parts):
                e = y[:, m, None, :] - self.centres[m]
                own = (e * u[:, m, None, :]).sum(axis=2)
                rest = total - along[:, m]
                cost = (e**2).sum(axis=2) + (self.parallel - 1) * (rest[:, None] + own) ** 2
                codes[:, m] = cost.argmin(axis=1)
                along[:, m] = own[np.arange(len(x)), codes[:, m]]
                total = rest + along[:, m]
        return codes

    def fit(self, x: np.ndarray, rounds: int = 4, seed: int = 3) -> Quantiser:
        """Alternate codes and centres; the centres of all parts solve one weighted least-squares problem."""
        rng = np.random.default_rng(seed)
        y, u = self._split(x), self._split(x / np.linalg.norm(x, axis=1, keepdims=True))
        self.centres = np.stack([y[rng.choice(len(x), 16, replace=len(x) < 16), m] for m in range(self.parts)])
        for _ in range(4):
            for m in range(self.parts):
                near = ((y[:, m, None, :] - self.centres[m]) ** 2).sum(axis=2).argmin(axis=1)
                for c in range(16):
                    if (near == c).any():
                        self.centres[m, c] = y[near == c, m].mean(axis=0)
        size = self.parts * 32
        for _ in range(rounds):
            codes = self.assign(x)
            column = (np.arange(self.parts) * 32 + codes * 2)[:, :, None] + np.arange(2)
            spread = np.zeros((len(x), size))
            np.put_along_axis(spread, column.reshape(len(x), -1), u.reshape(len(x), -1), axis=1)
            weight = np.bincount(column.ravel(), minlength=size).astype(float)
            target = np.bincount(column.ravel(), weights=y.ravel(), minlength=size)
            length = (y * u).sum(axis=(1, 2))
            normal = (self.parallel - 1) * (spread.T @ spread) + np.diag(weight + 1e-6)
            right = target + (self.parallel - 1) * (spread.T @ length) + 1e-6 * self.centres.ravel()
            self.centres = np.linalg.solve(normal, right).reshape(self.parts, 16, 2)
        return self

    def error(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """By how much a query of length 1 can score above the sum of its tables, rounding of the tables included."""
        near = self.centres[np.arange(self.parts), codes].reshape(len(x), 2 * self.parts)
        rounding = (self.parts + 8) * 2.0**-23 * np.linalg.norm(near, axis=1)
        return np.linalg.norm(self._split(x).reshape(len(x), -1) - near, axis=1) * (1 + 1e-9) + rounding

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query, inner products with pairs of centres: one table of 256 for every packed byte."""
        each = np.einsum("qmd,mcd->qmc", self._split(queries), self.centres).astype(np.float32)
        return (each[:, 1::2, :, None] + each[:, ::2, None, :]).reshape(len(queries), -1, 256)


class Nearest:
    """The ``k`` best of each of some queries among all vectors seen so far."""

    def __init__(self, quantiser: Quantiser, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
        self.quantiser, self.ids, self.queries, self.k, self.rerank = quantiser, ids, queries, k, rerank
        self.norms = np.linalg.norm(queries, axis=1)
        self.scores, self.best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def scan(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray) -> None:
        """Add a block of vectors: ``codes`` has a row for each packed byte."""
        near, part = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
        for lo in range(0, len(self.ids), TABLES):
            for at, tables in enumerate(self.quantiser.tables(self.queries[lo : lo + TABLES]), lo):
                near[:] = 0
                for own, byte in zip(tables, codes, strict=True):
                    near += np.take(own, byte, out=part, mode="clip")
                other = ids != self.ids[at]
                near[~other] = -np.inf
                best = _largest(near, self.k * self.rerank)
                best = best[other[best]]
                self._add(at, ids, x, best)
                # whatever its error lets reach the last of the best is reranked too
                rest = other & ~(near + self.norms[at] * error < self.scores[at, -1])
                rest[best] = False
                self._add(at, ids, x, np.flatnonzero(rest))

    def _add(self, at: int, ids: np.ndarray, x: np.ndarray, places: np.ndarray) -> None:
        if not len(places):
            return
        x, ids, query = x[places], ids[places], self.queries[at]
        if self.scores[at, -1] > -np.inf:
            # rounding cannot lift the others to the last of the best
            some = np.flatnonzero(x @ query >= self.scores[at, -1] - 1e-9 * self.norms[at] * np.abs(x).max() * len(query))
            x, ids = x[some], ids[some]
        # summed from the first component to the last
        scores = np.concatenate((self.scores[at], np.cumsum(x * query, axis=1)[:, -1]))
        own = np.concatenate((self.best[at], ids))
        order = np.lexsort((own, -scores))[: self.k]
        self.scores[at], self.best[at] = scores[order], own[order]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of queries, ids of vectors and scores."""
        query, place = np.nonzero(self.scores > -np.inf)
        return self.ids[query], self.best[query, place], self.scores[query, place]


def search(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query row, its own left out.

    ``vectors`` has vec_id and embedding; further columns are ignored. Vectors that are null, zero, hold
    null or non-finite components or have another dimension than most take no part, nor do rows without
    vec_id. The result is exact at any ``sample`` and ``rerank``: these only say on how many rows codebooks are fitted, and
    how many candidates are reranked before the bound on the others is known. Scores are in double precision, summed
    in the order of components; ties go to the smaller vec_id. Rows that
    repeat a vec_id are candidates each, and a query takes the least of their vectors.
    An empty table gives an empty result. Queries are broadcast QUERIES at a time, each time to one pass over the coded vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("query")).filter(F.col("vec_id").isNotNull() & usable("embedding"))
    dimension, n = most_common_dimension(rows, "embedding")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == dimension)
    drawn = least_hashed(rows, sample, 1, "vec_id", total=n).select("embedding").toArrow()
    shared = spark.sparkContext.broadcast(Quantiser(dimension).fit(matrix(drawn.column(0), dimension)))
    queries = numbered(rows.filter("query").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vec_id")
    asked = queries.count()
    tasks = min(-(-n // VECTORS), max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def encode(batches):
        quantiser = shared.value
        for batch in batches:
            x = matrix(batch.column(1), dimension)
            codes = quantiser.assign(x) if len(x) else np.zeros((0, quantiser.parts), np.int64)
            packed = pa.array([c.tobytes() for c in quantiser.pack(codes)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(quantiser.error(x, codes))], ["vec_id", "embedding", "code", "error"])

    def scanner(asked):
        def scan(batches):
            nearest = Nearest(shared.value, *asked.value, k, rerank)
            for block in _blocks(batches):
                codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(block.num_rows, -1).T.copy()
                nearest.scan(block.column("vec_id").to_numpy(), matrix(block.column("embedding"), dimension), codes, block.column("error").to_numpy())
            columns = nearest.found()
            for lo in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in columns], ["query_id", "vec_id", "score"])

        return scan

    coded = checkpointed(rows.select("vec_id", "embedding").repartition(tasks).mapInArrow(frugal(encode), "vec_id long, embedding array<double>, code binary, error double"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done = []
    for first in range(0, max(1, asked), QUERIES):
        own = queries.filter(F.col("row").between(first, first + QUERIES - 1)).select("vec_id", "embedding").toArrow()
        sent = spark.sparkContext.broadcast((own.column(0).to_numpy(), matrix(own.column(1), dimension)))
        found = coded.mapInArrow(frugal(scanner(sent)), "query_id long, vec_id long, score double")
        ranked = found.withColumn("rank", F.row_number().over(by_query).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if asked > QUERIES:
            ranked = checkpointed(ranked)
            sent.destroy()
        done.append(ranked)
    return reduce(DataFrame.unionAll, done)


def _blocks(batches):
    """Batches joined to at least VECTORS rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= VECTORS:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _largest(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest values; of equal ones, the first places."""
    if len(values) <= n:
        return np.arange(len(values))
    edge = np.partition(values, len(values) - n)[len(values) - n]
    above, equal = np.flatnonzero(values > edge), np.flatnonzero(values == edge)
    return np.concatenate((above, equal[: n - len(above)]))


def op1_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
