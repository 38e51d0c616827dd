"""Removal of lines that several documents hold, but for the first document that holds each.

Two Bloom filters, one of keys seen once and one of keys seen twice, are filled by every task over its own
documents and merged; what is in both of two tasks' first filters enters the second. Only lines that the second filter
knows are shuffled, as digests, to be confirmed exactly and to find their smallest doc_id. The filters have no false
negatives, so their size decides what is shuffled and never the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import checkpointed
from ._common import distinct, frugal, plan_bytes, release, sliced, small_batches, string_hashes, table, text_column

#: Code points of the shortest key that counts.
LEAST = 10
#: Bits of a filter: as many as a fourth of the bytes read, between these; the largest is 128 MB.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 30
#: Bits of a piece in which filters are merged, and of a block that holds all bits of one key.
PIECE, BLOCK, PROBES = 1 << 19, 512, 4
#: doc_ids that are broadcast at most (16 bytes each); beyond, the texts of documents that lose lines are joined by shuffling all.
BROADCAST_IDS = 1 << 21
#: A key with more than this share of the suspected rows is hot; there can be no more of them than its inverse.
HOT = 1000
_SPACES = " \t\n\x0b\x0c\r"
_U64 = np.uint64


def _keys(texts: pa.Array):
    """(lines, keys, each line's row, the lines that count) of a column of texts."""
    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    keys = pc.ascii_lower(pc.ascii_trim(lines, _SPACES))
    row = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    return lines, keys, row, np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), LEAST).to_numpy(zero_copy_only=False))


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The positions of each hash, one row for each probe."""
    block = (hashes >> _U64(40)) % _U64(bits // BLOCK) * _U64(BLOCK)
    return np.stack([block + ((hashes >> _U64(9 * i)) & _U64(BLOCK - 1)) for i in range(PROBES)])


def _held(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((words[at >> _U64(6)] >> (at & _U64(63))) & _U64(1)).all(axis=0)


def _put(words: np.ndarray, at: np.ndarray) -> None:
    at = distinct(at.reshape(-1))
    word = at >> _U64(6)
    first = np.flatnonzero(np.diff(word, prepend=~word[:1]))
    if len(first):
        words[word[first]] |= np.bitwise_or.reduceat(_U64(1) << (at & _U64(63)), first)


def _seen(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    """Enter one hash for each document that holds the key."""
    keys, counts = np.unique(hashes, return_counts=True)
    at = _bits(keys, bits)
    _put(twice, at[:, (counts > 1) | _held(once, at)])
    _put(once, at)


def seen_twice(docs: DataFrame, bits: int) -> np.ndarray:
    """The filter of keys that may be in two documents; of the documents' keys all that are in two are in it."""

    def fill(batches):
        once, twice = (np.zeros(bits // 64, _U64) for _ in range(2))
        for batch in batches:
            for _, part in sliced(batch.column(0), 1 << 22):
                _, keys, row, long = _keys(part)
                hashes = string_hashes(keys.take(pa.array(long)))
                own = np.lexsort((hashes, row[long]))
                h, r = hashes[own], row[long][own]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                _seen(once, twice, h[first], bits)
        step = PIECE // 64
        for k in range(bits // PIECE):
            a, b = once[k * step : (k + 1) * step], twice[k * step : (k + 1) * step]
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()) for x in (a, b))], ["piece", "once", "twice"])

    def merge(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, *pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = (np.frombuffer(pa.decompress(x, PIECE // 8, "zstd", asbytes=True), _U64) for x in pair)
                own = held.setdefault(k, [np.zeros(PIECE // 64, _U64), np.zeros(PIECE // 64, _U64)])
                own[1] |= twice | (own[0] & once)
                own[0] |= once
        for k, (_, twice) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(twice.tobytes(), "zstd", asbytes=True)], pa.binary())], ["piece", "twice"])

    spark = docs.sparkSession
    parts = docs.select(text_column().alias("text")).mapInArrow(frugal(fill), "piece int, once binary, twice binary")
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "piece")
    out = np.zeros((bits // PIECE, PIECE // 64), _U64)
    for r in parts.mapInArrow(frugal(merge), "piece int, twice binary").toLocalIterator():
        out[r["piece"]] = np.frombuffer(pa.decompress(bytes(r["twice"]), PIECE // 8, "zstd", asbytes=True), _U64)
    return out.reshape(-1)


def _digest(key: str) -> bytes:
    return hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()


def suspected(docs: DataFrame, twice: np.ndarray) -> DataFrame:
    """(doc_id, digest) of each distinct key of a document that the filter knows."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    bits = 64 * len(twice)

    def run(batches):
        words = shared.value
        for batch in batches:
            ids = batch.column(0)
            for first, part in sliced(batch.column(1), 1 << 22):
                _, keys, row, long = _keys(part)
                keys = keys.take(pa.array(long))
                at = np.flatnonzero(_held(words, _bits(string_hashes(keys), bits)))
                pairs = sorted({(r, _digest(k)) for r, k in zip(row[long[at]].tolist(), keys.take(pa.array(at)).to_pylist(), strict=True)})
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([first + r for r, _ in pairs], pa.int64())), pa.array([d for _, d in pairs], pa.binary())], ["doc_id", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, digest binary")


def lost_lines(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, digests): the keys whose lines a document loses, for documents that lose any."""
    small_batches(docs.sparkSession)
    bits = LEAST_BITS
    while bits < min(most_bits, plan_bytes(docs.select("text")) // 4):
        bits *= 2
    rows = checkpointed(suspected(docs, seen_twice(docs, bits)))
    release(docs.sparkSession)
    # a key is in two documents if its smallest and largest doc_id differ; null is an id of its own, after all others
    found = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.bool_or(F.col("doc_id").isNull()).alias("without"), F.count("*").alias("rows"))
    found = checkpointed(found.filter("least <> most or without and least is not null").select("digest", "least", "rows"))
    hot = F.broadcast(found.filter(F.col("rows") > F.lit(rows.count() // HOT)).select("digest", "least"))
    cold = rows.join(hot.select("digest"), "digest", "left_anti").join(found.select("digest", "least"), "digest")
    lost = rows.join(hot, "digest").unionByName(cold).filter(~F.col("doc_id").eqNullSafe(F.col("least")))
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))


def deduplicated(docs: DataFrame, n_lines: str | None = None, n_dropped: str | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` with all their columns, the text without the lines that the document loses.

    Texts are cut at line feeds; a null or empty text is one empty line and becomes or stays empty. A line's key is the line
    without white space at its ends, A-Z lower-cased. A key of LEAST code points or more that several documents hold
    stays in the one of smallest doc_id, wherever it stands there, and goes elsewhere. Rows of one doc_id are one document; those
    without doc_id are one more, after all others. ``n_lines`` and ``n_dropped`` name columns to be added with the lines before and
    those gone; columns of these names are replaced. An empty table gives an empty one.
    """
    lost = checkpointed(lost_lines(docs, most_bits))
    release(docs.sparkSession)
    text = text_column()
    rows = docs.withColumns({"text": text} | ({n_lines: F.size(F.split(text, "\n", -1)).cast("long")} if n_lines else {}))
    added = [n_dropped] if n_dropped else []
    kept = [c for c in rows.columns if c not in added]
    ids = lost.select(F.col("doc_id").alias("__of"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__of"))
    few = ids.count() <= BROADCAST_IDS
    whole = rows.join(F.broadcast(ids), same, "left_anti") if few else None
    losing = (rows.join(F.broadcast(ids), same, "left_semi") if few else rows).join(lost.select(F.col("doc_id").alias("__of"), F.col("digests").alias("__digests")), same, "inner" if few else "left")
    losing = losing.select(*kept, "__digests")
    at = kept.index("text")
    schema = losing.select(*kept, F.lit(0).cast("long").alias("__gone")).schema

    def drop(batches):
        for batch in batches:
            texts, gone = [], []
            digests = batch.column(len(kept))
            for first, part in sliced(batch.column(at)):
                lines, keys, own, long = _keys(part)
                stays = np.ones(len(lines), bool)
                for k in np.split(long, np.flatnonzero(np.diff(own[long])) + 1):
                    lose = set(digests[first + int(own[k[0]])].as_py() or ()) if len(k) else ()
                    if lose:
                        stays[k] = [_digest(x) not in lose for x in keys.take(pa.array(k)).to_pylist()]
                left = np.bincount(own[stays], minlength=len(part))
                lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(left))), lines.filter(pa.array(stays)))
                texts.append(pc.binary_join(lists, pa.scalar("\n", lines.type)).cast(pa.string()))
                gone.append(np.bincount(own, minlength=len(part)) - left)
            columns = batch.columns[: len(kept)]
            columns[at] = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(gone) if gone else [], pa.int64())], [*kept, "__gone"])

    out = losing.mapInArrow(frugal(drop), schema)
    names = {n_dropped: F.col("__gone")} if n_dropped else {}
    out = out.withColumns(names).select(*kept, *added)
    return out if whole is None else out.unionByName(whole.withColumns({n: F.lit(0).cast("long") for n in added}).select(*kept, *added))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), "n_lines", "n_dropped")
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
