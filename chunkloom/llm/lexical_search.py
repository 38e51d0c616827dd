"""Ranked lexical search of whole texts by WAND in shards of documents.

A partition of the documents is a shard; no postings are shuffled. The shard's texts are turned into lists of postings
for the queries' terms, window by window, and every query keeps a heap of its best documents over all windows of
the shard. In a window the largest impact of each of a query's lists bounds what the list can add. The pivot is the
list at which these maxima, added from the smallest, reach the heap's threshold: documents that stand only in lists before it
cannot enter the heap and are skipped, and of the others those are scored whose bound still reaches it. The shards' heaps are
merged. Results are those of scoring every document.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import checkpointed
from ._common import frugal, small_batches, table, text_column
from ._terms import LETTERS_AND_DIGITS, terms

#: Documents found for each query.
BEST = 20
#: Queries that are broadcast at once; each block of them is one more pass over the documents.
BLOCK = 4096
#: Bytes of text in a window, about.
WINDOW = 1 << 22
#: Heaps are first merged in so many groups of shards.
MERGES = 64

# Fixed values of the score: units of weights and of impacts, how fast repeats saturate, and the share of length in it, in percent.
WEIGHT_UNIT, IMPACT_UNIT, COUNT_UNIT, SATURATION, LENGTH_PART = 1000, 1_000_000_000, 1000, 12, 25


class Queries:
    """A block of queries: the distinct terms, each query's terms with their repeats, and then the weights of the terms."""

    def __init__(self, texts: pa.Array):
        distinct, self.lists = {}, []
        for _, rows, words, code, row in terms(texts, LETTERS_AND_DIGITS):
            known = np.array([distinct.setdefault(w, len(distinct)) for w in words.to_pylist()], np.int64)
            for k in range(rows):
                self.lists.append(np.unique(known[code[row == k]], return_counts=True))
        self.terms = pa.array(list(distinct), pa.large_string())
        self.weights = np.zeros(len(distinct), np.int64)
        self.documents = self.length = 0

    def postings(self, texts: pa.Array):
        """(first row, rows, terms of each row, rows, query terms, counts) of each window, by row, then term."""
        for first, rows, words, code, row in terms(texts, LETTERS_AND_DIGITS, WINDOW):
            lengths = np.bincount(row, minlength=rows)
            known = pc.index_in(words, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            own = known[code]
            cells, counts = np.unique(row[own >= 0] * max(1, len(self.terms)) + own[own >= 0], return_counts=True)
            yield first, rows, lengths, cells // max(1, len(self.terms)), cells % max(1, len(self.terms)), counts

    def impacts(self, lengths: np.ndarray, row: np.ndarray, term: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What each posting adds to the score of a query that has the term once."""
        if len(lengths) and int(lengths.max()) * LENGTH_PART * self.documents >= 1 << 63:  # beyond what numpy's integers hold
            scaled = np.array([LENGTH_PART * int(n) * self.documents // self.length for n in lengths], np.int64)
        else:
            scaled = LENGTH_PART * lengths * self.documents // max(1, self.length)
        return self.weights[term] * (IMPACT_UNIT * counts // (COUNT_UNIT * counts + SATURATION * (100 - LENGTH_PART + scaled[row])))


class Heaps:
    """The best documents of every query, over the windows of a shard."""

    def __init__(self, queries: Queries, best: int):
        self.queries, self.best = queries, best
        none = np.zeros(0, np.int64)
        self.kept = [(none, none, none)] * len(queries.lists)  # score, without doc_id, doc_id; best first

    def add(self, ids: pa.Array, rows: int, lengths: np.ndarray, row: np.ndarray, term: np.ndarray, counts: np.ndarray) -> None:
        q = self.queries
        impact = q.impacts(lengths, row, term, counts)
        by_term = np.argsort(term, kind="stable")
        list_row, list_impact, of_term = row[by_term], impact[by_term], term[by_term]
        begin = np.searchsorted(of_term, np.arange(len(q.terms) + 1))
        maxima = np.zeros(len(q.terms), np.int64)
        some = np.flatnonzero(np.diff(begin))
        if len(some):
            maxima[some] = np.maximum.reduceat(list_impact, begin[some])
        of_row = np.searchsorted(row, np.arange(rows + 1))
        repeats = np.zeros(len(q.terms), np.int64)
        without = np.asarray(ids.is_null())
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for k, (own, times) in enumerate(q.lists):
            bound = maxima[own] * times
            least = self.kept[k][0][-1] if len(self.kept[k][0]) == self.best else 1
            if bound.sum() < least:
                continue
            up = np.argsort(bound, kind="stable")
            below = np.cumsum(bound[up])
            pivot = int(np.searchsorted(below, least, "left"))
            rest = int(below[pivot - 1]) if pivot else 0
            lists = [(begin[own[t]], begin[own[t] + 1], times[t]) for t in up[pivot:]]
            reached = np.zeros(rows)  # sums stay below 2 ** 53, so they are exact
            for a, b, n in lists:
                reached += np.bincount(list_row[a:b], weights=list_impact[a:b] * n, minlength=rows)
            at = np.flatnonzero((reached > 0) & (reached + rest >= least))
            if not len(at):
                continue
            if pivot:
                repeats[own] = times
                at, score = self._whole(at, of_row, term, impact, repeats)
                repeats[own] = 0
            else:
                score = reached[at].astype(np.int64)
            self._keep(k, score, without[at], number[at], least)

    @staticmethod
    def _whole(at: np.ndarray, of_row: np.ndarray, term: np.ndarray, impact: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``at`` with their full scores."""
        counts = of_row[at + 1] - of_row[at]
        first = np.cumsum(counts) - counts
        cell = np.repeat(of_row[at] - first, counts) + np.arange(counts.sum())
        return at, np.add.reduceat(impact[cell] * repeats[term[cell]], first)

    def _keep(self, k: int, score: np.ndarray, without: np.ndarray, number: np.ndarray, least: int) -> None:
        enough = score >= least
        score, without, number = (np.concatenate((old, new[enough])) for old, new in zip(self.kept[k], (score, without, number), strict=True))
        order = np.lexsort((number, without, -score))[: self.best]
        self.kept[k] = score[order], without[order], number[order]


def _statistics(docs: DataFrame, queries: Queries) -> None:
    """Count all documents and terms, and the documents that hold each query's term; set the weights."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def count(batches):
        q = shared.value
        held, documents, length = np.zeros(len(q.terms), np.int64), 0, 0
        for batch in batches:
            for _, _, lengths, _, term, _ in q.postings(batch.column(0)):
                held += np.bincount(term, minlength=len(held))
                documents += int(np.count_nonzero(lengths))
                length += int(lengths.sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((some, [-1, -2]))), pa.array(np.concatenate((held[some], [documents, length])))], ["term", "n"])

    found = docs.select(text_column().alias("text")).mapInArrow(frugal(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    sums = {r["term"]: r["n"] for r in found.collect()}  # as many as the block's queries have terms
    queries.documents, queries.length = sums.pop(-1, 0), sums.pop(-2, 0)
    held = np.array([sums.get(t, 0) for t in range(len(queries.terms))], np.float64)
    queries.weights = np.floor(WEIGHT_UNIT * np.log((2 * queries.documents + 2) / (2 * held + 1))).astype(np.int64)
    shared.destroy()


def _block(docs: DataFrame, items: pa.Table, best: int) -> DataFrame:
    queries = Queries(items.column("text").cast(pa.large_string()).combine_chunks())
    ids = items.column("item_id").to_numpy()
    _statistics(docs, queries)
    shared = docs.sparkSession.sparkContext.broadcast((ids, queries))

    def search(batches):
        ids, q = shared.value
        heaps = Heaps(q, best)
        for batch in batches:
            for first, rows, *postings in q.postings(batch.column(1)):
                heaps.add(batch.column(0).slice(first, rows), rows, *postings)
        counts = [len(score) for score, _, _ in heaps.kept]
        score, without, number = (np.concatenate([h[c] for h in heaps.kept]) if heaps.kept else np.zeros(0, np.int64) for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(number, pa.int64(), mask=without.astype(bool)), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return rows.mapInArrow(frugal(search), "item_id long, doc_id long, score long").withColumn("__shards", F.pmod(F.spark_partition_id(), F.lit(MERGES)))


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each of ``items`` (item_id, text) the ``best`` rows of ``docs`` with a score above 0.

    Ranks count from 1, best first, ties by doc_id, null last. Every row of ``docs`` is a document; a null text has no term. Items
    without item_id take no part; of rows that repeat an item_id the one with the least text counts. Other columns are not read.
    Without documents or items there are no rows.
    """
    small_batches(docs.sparkSession)
    items = items.filter("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    items = checkpointed(items)
    blocks = -(-items.count() // BLOCK)
    found = [_block(docs, items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow().sort_by("item_id"), best) for b in range(blocks)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    of_some = F.row_number().over(Window.partitionBy("item_id", "__shards").orderBy(*order))
    rows = reduce(DataFrame.unionByName, found).withColumn("rank", of_some).filter(F.col("rank") <= best)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
