"""Near-duplicate vectors by a pivot-permutation index that loses no link.

A vector is described by its nearest pivots in order, PREFIX of them, and by the set of pivots that
lie at most twice the threshold's distance farther off than the last of these. By the triangle inequality, two vectors
within the threshold have all of each other's nearest pivots in these sets. A vector is posted in the inverted list of its
nearest pivot; it looks up the lists of the pivots in its set that bounds on distances leave, shared pivots are
counted for every pair that meets, and pairs that share all of them are verified by their exact cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpointed, components, least_hashed, table
from ._vectors import matrix, most_common_dimension, usable

#: Pivots are twice the root of the vectors' number at most, between these; drawn farthest-first from CANDIDATES times as many.
FEWEST_PIVOTS, MOST_PIVOTS, CANDIDATES = 16, 4096, 4
#: Nearest pivots that describe a vector, in order.
PREFIX = 4
#: Share of the pairs of a block up to which only candidates' cosines are computed, one by one.
FEW = 1 / 16
#: Lists are cut in tiles of about this many vectors, and each pair of tiles is its own group.
TILE = 1024
#: More than rounding can move a distance of unit vectors.
SLACK = 1e-6


def spread_out(x: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Places of at most ``most`` unit vectors, each the farthest from those before; none is within ``apart`` of another."""
    chosen, cosine = [0], x @ x[0]
    while len(chosen) < most:
        k = int(cosine.argmin())
        if 2 - 2 * cosine[k] <= apart * apart:
            break
        chosen.append(k)
        cosine = np.maximum(cosine, x @ x[k])
    return np.array(chosen)


def permutations(far: np.ndarray, prefix: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest pivots in order, the last one's distance, and the packed set of the pivots at most 2 ``reach`` beyond it."""
    order = np.argsort(far, axis=1, kind="stable")[:, :prefix].astype(np.int32)
    last = np.take_along_axis(far, order[:, -1:], axis=1)[:, 0]
    return order, last, np.packbits(far <= last[:, None] + 2 * reach + SLACK, axis=1)


def _bits(packed: pa.ChunkedArray, n: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    return np.unpackbits(rows, axis=1, count=n).astype(bool)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label link if their cosine, in double precision, is at least ``cosine``; all such pairs are
    found, at any PREFIX and number of pivots. Equal vectors are one class: they are linked
    with each other without a search, and a class is searched once. Vectors that are null, zero, hold
    null or non-finite components or have another dimension than most, and rows with null label or vec_id, link
    with nothing. n_links counts linked rows, component_id is the smallest vec_id reachable, kept whether it is the
    row's own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("label"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    dimension, _ = most_common_dimension(good, "embedding")
    linkable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("embedding") & (F.size("embedding") == dimension), F.lit(False))
    keyed = rows.select("vec_id", "label", "embedding", F.when(linkable, F.xxhash64(F.lit(1), "label", "embedding")).alias("k1"), F.when(linkable, F.xxhash64(F.lit(2), "label", "embedding")).alias("k2"))
    classes = checkpointed(keyed.filter("k1 is not null").groupBy("label", "embedding", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    most = min(MOST_PIVOTS, max(FEWEST_PIVOTS, int(2 * n**0.5)))
    pivots = matrix(least_hashed(classes, CANDIDATES * most, 2, "id", total=n).select("embedding").toArrow().column(0), dimension)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    reach = max(0.0, 2 - 2 * cosine) ** 0.5 + SLACK
    index = spark.sparkContext.broadcast(pivots[spread_out(pivots, most, 2 * reach)])

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (x / np.linalg.norm(x, axis=1, keepdims=True)) @ index.value.T, 0))

    prefix = min(PREFIX, len(index.value))

    def settle(batches):
        for batch in batches:
            far = distances(matrix(batch.column(1), dimension)) if len(batch) else np.zeros((0, prefix))
            order, last, near = permutations(far, prefix, reach)
            described = [pa.array(order[:, 0]), pa.array(far[np.arange(len(far)), order[:, 0]]), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (order, near))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *described], ["id", "embedding", "label", "copies", "pivot", "far", "order", "near"])

    label = f"label {rows.schema['label'].dataType.simpleString()}"
    described = "`order` binary, near binary"
    settled = checkpointed(classes.select("id", "embedding", "label", "copies").mapInArrow(settle, f"id long, embedding array<double>, {label}, copies long, pivot int, far double, {described}"))
    own, before = Window.partitionBy("label"), Window.partitionBy("label").orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)
    cells = settled.groupBy("label", "pivot").agg(F.count("*").alias("n"), F.min("far").alias("nearest"), F.max("far").alias("farthest"))
    cells = checkpointed(cells.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")), "total": F.sum("n").over(own)}))
    # a vector's place among those of its label: in its cell's range, spread by a hash
    place = F.col("first") + F.shiftright(F.col("n") * F.pmod(F.xxhash64("id", "embedding"), F.lit(1 << 20)), 20)
    housed = settled.join(cells.select("label", "pivot", "n", "first"), ["label", "pivot"]).withColumn("tile", F.floor(place / TILE).cast("int"))
    housed = housed.select("id", "embedding", "label", "copies", "order", "near", "tile", F.shiftright("tile", 2).alias("part"))
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / TILE / 4).cast("int")))
    known = cells.select(F.col("label").alias("name"), "pivot", "n", "first", "nearest", "farthest", parts.alias("part"))

    def reachable(left: pa.Table, right: pa.Table) -> pa.Table:
        """The tiles of the lists of pivots in a vector's set, whose vectors' distances to the pivots allow one within reach."""
        x, pivot, n, first, nearest, farthest = matrix(left.column("embedding"), dimension), *(right.column(c).to_numpy() for c in ("pivot", "n", "first", "nearest", "farthest"))
        far, between = distances(x), distances(index.value)
        home = far.argmin(axis=1)
        near = _bits(left.column("near"), len(between))[:, pivot]
        # what is nearer to the pivot than to one's own lies beyond the plane between them
        over = near & ((far[:, pivot] ** 2 - far[np.arange(len(x)), home, None] ** 2) / 2 <= reach * between[home][:, pivot] + SLACK)
        over &= (far[:, pivot] <= farthest + reach) & (far[:, pivot] >= nearest - reach)
        lows, highs = first // TILE, (first + n - 1) // TILE
        edges = np.zeros((len(x), int(highs.max()) + 2), np.int32)
        for c in range(len(pivot)):
            edges[:, lows[c]] += over[:, c]
            edges[:, highs[c] + 1] -= over[:, c]
        met = np.cumsum(edges, axis=1)[:, :-1] > 0
        met[np.arange(len(x)), left.column("tile").to_numpy()] = True
        others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(met.sum(axis=1))), pa.int32()), pa.array(np.nonzero(met)[1].astype(np.int32)))
        return left.drop_columns(["part"]).append_column("other", others)

    meeting = housed.groupBy("label", "part").cogroup(known.groupBy("name", "part")).applyInArrow(reachable, f"id long, embedding array<double>, {label}, copies long, {described}, tile int, other array<int>")
    meeting = meeting.withColumn("other", F.explode("other")).select("id", "embedding", "copies", "order", "near", "label", "tile", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"))

    def verify(group: pa.Table) -> pa.Table:
        ids, x, copies = group.column("id").to_numpy(), matrix(group.column("embedding"), dimension), group.column("copies").to_numpy()
        tile, t1, t2 = group.column("tile").to_numpy(), group.column("t1")[0].as_py(), group.column("t2")[0].as_py()
        norm = np.sqrt((x * x).sum(axis=1))
        unit = x / norm[:, None]
        order = np.frombuffer(b"".join(group.column("order").to_pylist()), np.int32).reshape(len(ids), -1)
        near = _bits(group.column("near"), len(index.value))
        shared = np.zeros((len(ids), len(ids)), np.uint8)
        for k in range(prefix):
            shared += near[:, order[:, k]]
        candidate = (shared == prefix) & (shared.T == prefix)
        if t1 != t2:
            candidate &= tile[:, None] != tile[None, :]
        linked = np.zeros((len(ids), len(ids)), bool)
        for lo in range(0, len(ids), 512):
            part = slice(lo, lo + 512)
            mine, unsure = np.zeros_like(candidate[part]), candidate[part]
            if unsure.sum() > FEW * unsure.size:
                cosines = unit[part] @ unit.T
                mine = unsure & (cosines >= cosine + 1e-9)
                unsure = unsure & (cosines >= cosine - 1e-9) & ~mine
            a, b = np.nonzero(unsure)
            for s in range(0, len(a), 1 << 16):
                i, j = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                mine[i, j] = (x[i + lo] * x[j]).sum(axis=1) / (norm[i + lo] * norm[j]) >= cosine
            linked[part] = mine
        np.fill_diagonal(linked, False)
        links = np.array([copies[row].sum() for row in linked], np.int64)
        top, unseen = np.arange(len(ids)), np.ones(len(ids), bool)
        for k in range(len(ids)):
            waiting = [k] if unseen[k] else []
            unseen[k] = False
            while waiting:
                new = np.flatnonzero(linked[waiting.pop()] & unseen)
                unseen[new], top[new] = False, k
                waiting.extend(new.tolist())
        some = np.flatnonzero(links > 0)
        return pa.table({"id": ids[some], "other": ids[top[some]], "links": links[some]})

    found = checkpointed(meeting.groupBy("label", "t1", "t2").applyInArrow(verify, "id long, other long, links long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")).filter("a <> b"))
    named = classes.select("k1", "k2", "id", "copies").join(links, "id", "left").join(groups, "id", "left")
    named = named.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.select("vec_id", "k1", "k2")
    out = out.filter("k1 is not null").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(keyed.filter("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
