"""Audit of how the sources of a language differ in their words.

Each source's smoothed share of every kept term is compared with every other source's and with its language's. Sums
over all terms are taken from the few that a source has, corrected by what two sources differ in the terms that neither has;
the terms that stand out are ranked by radix selection: histograms over digits of the value's bits narrow each group's threshold
down, and digits of the term's bytes decide among those that tie with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import checkpointed
from ._common import distinct, frugal, release, small_batches, table
from ._terms import LETTERS, terms

# What is added to every count, the unit of shares, the documents a kept term needs, the ranks of terms.
ADDED, UNIT, LEAST_DOCS, MOST_RANKS = 5, 1_000_000_000, 30, 50
#: Bits of a digit of the value, and the number of digits: shares are below 2 ** 30.
DIGIT, DIGITS = 10, 3
#: Hexadecimal places of a digit of a term's bytes.
PLACES = 4
#: Sources in a block and terms in a bucket, about, of those that one task compares.
SOURCES, TERMS = 128, 256
#: Bytes of text that are counted at once, about.
SLICE = 1 << 23
#: Rows of a table with one row for each group that are broadcast at most.
BROADCAST_GROUPS = 1 << 18


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, occurrences, docs): sums over all rows; one row without term for each (lang, source)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keys = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
            pair = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(zero_copy_only=False)
            for first, rows, words, code, row in terms(batch.column(2), LETTERS, SLICE):
                width = max(1, len(words))
                _, at, group = np.unique(pair[first : first + rows], return_index=True, return_inverse=True)
                own = group[row] * width + code
                cells, occurrences = np.unique(own, return_counts=True)
                once = distinct(row * width + code)
                holders = np.bincount(np.searchsorted(cells, group[once // width] * width + once % width), minlength=len(cells))
                of = pa.array(np.concatenate((at[cells // width], at)) + first)
                named = pa.concat_arrays([words.cast(pa.string()).take(pa.array(cells % width)), pa.nulls(len(at), pa.string())])
                zeros = np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays([*keys.take(of).flatten(), named, pa.array(np.concatenate((occurrences, zeros))), pa.array(np.concatenate((holders, zeros)))], ["lang", "source", "term", "occurrences", "docs"])

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    each = rows.mapInArrow(frugal(run), "lang string, source string, term string, occurrences long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("docs").alias("docs"))


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """A term's share in units of 10 ** -9, smoothed and rounded down, plus 1; exact whatever the counts."""
    count, total, kept = (F.col(c) if isinstance(c, str) else c for c in (count, total, kept))
    over = (count + F.lit(ADDED)).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    under = (total + F.lit(ADDED) * kept).cast("decimal(20,0)")
    return F.call_function("div", over, under) + F.lit(1).cast("long")


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` to be broadcast, if there are at most BROADCAST_GROUPS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_GROUPS else rows


def shares(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept terms that each group has, (lang, source, term, p, q), and the groups, (lang, source, kept, base).

    ``base`` is the share of a term that the group lacks, null where the language keeps no term.
    """
    counts = checkpointed(term_counts(docs))
    release(docs.sparkSession)
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("all"))
    kept = checkpointed(kept.filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", "all"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("all_total"))
    has = checkpointed(counts.filter("term is not null").join(kept, ["lang", "term"]))
    totals = has.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(_small(checkpointed(langs)), "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "all_total"])
    groups = checkpointed(groups.withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0), "total", "kept"))))
    own = has.join(_small(groups), ["lang", "source"])
    own = own.select("lang", "source", "term", share("occurrences", "total", "kept").alias("p"), share("all", "all_total", "kept").alias("q"), "kept", "base")
    return checkpointed(own), groups


def pair_divergence(own: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways: differences of shares summed over all kept terms.

    Sources meet in tiles of two blocks and a bucket of terms, each in every bucket, also where it has none of its terms. A tile takes
    the terms that any of its sources has, less what the sources' bases differ for each; the first bucket adds that difference for all
    kept terms, and of the others' sums those that are not 0 go on.
    """
    blocks = _small(checkpointed(groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).cast("int").alias("blocks"))))
    buckets = F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1)).cast("int")
    rows = own.select("lang", "source", "term", "p", "kept", "base", F.pmod(F.xxhash64("term"), buckets).cast("int").alias("bucket"))
    every = F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket")
    rows = rows.unionByName(groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "kept", "base", every))
    rows = rows.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "bucket", "block", "source", "term", "p", "kept", F.coalesce("base", F.lit(0)).alias("base"))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        i, j, lang = int(f["i"].iloc[0]), int(f["j"].iloc[0]), f["lang"].iloc[0]
        first = f.drop_duplicates("source").sort_values("source")
        names, base, block = first["source"].to_numpy(), first["base"].to_numpy(np.int64), first["block"].to_numpy()
        place = {s: k for k, s in enumerate(names)}
        seeded = int(f["bucket"].iloc[0]) == 0
        real = f[f["term"].notna()]
        codes, found = pd.factorize(real["term"])
        p = np.repeat(base[:, None], len(found), axis=1)
        p[real["source"].map(place).to_numpy(np.int64), codes] = real["p"].to_numpy(np.int64)
        out = []
        for a in np.flatnonzero(block == i):
            others = np.flatnonzero(block == j)
            others = others[others > a] if i == j else others
            gap = np.abs(base[others] - base[a])
            value = np.abs(p[others] - p[a]).sum(axis=1) - len(found) * gap + (int(first["kept"].iloc[0]) * gap if seeded else 0)
            if not seeded:
                others, value = others[value != 0], value[value != 0]
            out.append(pd.DataFrame({"lang": lang, "source": names[a], "item": names[others], "value": value}))
        return pd.concat(out) if out else pd.DataFrame({"lang": lang, "source": "", "item": names[:0], "value": np.zeros(0, np.int64)})

    parts = rows.groupBy("lang", "i", "j", "bucket").applyInPandas(compare, "lang string, source string, item string, value long")
    both = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return both.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def _cut(histogram: DataFrame, keys: list[str], state: list[str], order: Column) -> DataFrame:
    """Of each group's digits (keys, state, digit, n) the one at which their counts, in the order given, reach ``need``."""
    to = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = histogram.withColumn("__to", F.sum("n").over(to)).filter((F.col("__to") >= F.col("need")) & (F.col("__to") - F.col("n") < F.col("need")))
    return rows.select(*keys, *(c for c in state if c != "need"), "digit", "n", (F.col("need") - F.col("__to") + F.col("n")).alias("need"))


def top_ranked(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Of each group the ``most`` rows (keys, item, value) of largest value, ties to the item of smaller UTF-8 bytes.

    Items of a group are distinct and values from 0 to below 2 ** 30. Every round counts, with partial sums before the
    shuffle, the rows of each group's open bin by their next digit; no group is sorted.
    """
    spark = rows.sparkSession
    sizes = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("__n")))
    state = sizes.filter(F.col("__n") > most).select(*keys, F.lit(0).cast("long").alias("low"), F.lit(most).cast("long").alias("need"))
    for shift in range(DIGIT * (DIGITS - 1), -1, -DIGIT):
        inside = rows.join(_small(state), keys).filter(F.shiftright("value", shift + DIGIT) == F.shiftright("low", shift + DIGIT))
        digit = F.shiftright("value", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        found = _cut(inside.groupBy(*keys, "low", "need", digit.alias("digit")).agg(F.count("*").alias("n")), keys, ["low", "need"], F.desc("digit"))
        state = checkpointed(found.select(*keys, (F.col("low") + F.shiftleft("digit", shift)).alias("low"), "need", "n"))
    # state: the threshold, how many rows at it are taken, and how many there are
    value = {"low": "threshold"}
    state = state.withColumnsRenamed(value)
    code = F.hex(F.encode("item", "UTF-8"))
    open_ = state.filter("n > need").select(*keys, "threshold", "need", F.lit("").alias("prefix"))
    closed = state.filter("n <= need").select(*keys, "threshold", F.lit(None).cast("string").alias("last"), F.lit(0).alias("seen"))
    ties = rows.join(_small(open_.select(*keys, "threshold")), keys).filter("value = threshold").select(*keys, code.alias("code"))
    ties = checkpointed(ties)
    at = 0
    while True:
        if open_.isEmpty():
            break
        inside = ties.join(_small(open_), keys).filter(F.substring("code", 1, at) == F.col("prefix"))
        digit = F.substring("code", at + 1, PLACES)
        found = checkpointed(_cut(inside.groupBy(*keys, "threshold", "prefix", "need", digit.alias("digit")).agg(F.count("*").alias("n")), keys, ["threshold", "prefix", "need"], F.col("digit")))
        prefix = F.concat("prefix", "digit")
        closed = closed.unionByName(found.filter("n <= need").select(*keys, "threshold", prefix.alias("last"), F.lit(at + PLACES).alias("seen")))
        open_ = found.filter("n > need").select(*keys, "threshold", "need", prefix.alias("prefix"))
        at += PLACES
    limits = sizes.select(*keys).join(checkpointed(closed), keys, "left")
    out = rows.join(_small(limits), keys)
    # as many places as were seen: an item that ends before them comes before those that go on
    tied = F.col("last").isNull() | (F.substring(code, F.lit(1), F.col("seen")) <= F.col("last"))
    out = out.filter(F.col("threshold").isNull() | (F.col("value") > F.col("threshold")) | (F.col("value") == F.col("threshold")) & tied)
    release(spark)
    return out.select(*keys, "item", "value")


def audit(docs: DataFrame, most: int = MOST_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how a source differs from each other one, and the terms that it uses most for its language.

    Null lang, source and text count as ''. Rows are documents, also if they repeat a doc_id. A language keeps the terms that
    LEAST_DOCS of its documents hold. A source whose texts hold no term has the smoothed share of every term; a language
    without kept terms has differences of 0 and no terms. Other columns are not read. An empty table gives no rows.
    """
    own, groups = shares(docs)
    keys = ["lang", "source"]
    pairs = pair_divergence(own, groups).select(*keys, F.lit("pair").alias("part"), "item", "value")
    more = own.filter("p > q").select(*keys, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = top_ranked(more, keys, most).select(*keys, F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(best).withColumn("rank", rank)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
