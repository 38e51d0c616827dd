"""Mixing of sources to target weights, each source's budget fitted as a subset sum.

A source's documents are counted by exact length. Whole copies and an equal share of every
length come first; what remains of the budget is filled by bounded-knapsack dynamic
programming over the counts of lengths. Which documents of a length are taken is drawn by a
seeded hash, so reruns agree.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, checkpointed, numbered, table, text_column

WEIGHTS = (5, 2, 1)
#: Documents of one source and length are counted in so many groups, by leading bits of their hash.
GROUPS = 4096
#: Words that are left to the exact search, in longest documents of the source; each next one is tried if the one before misses the budget.
SEARCHED = (1, 2, 4, 8, 16)
#: Lengths (of all sources) up to which their plan is broadcast; more are joined by shuffling.
BROADCAST_LENGTHS = 1 << 17
#: Rows of one repeated document that are ranked in one group: two to this power, at most.
TIED_BITS = 16


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, for a sum as near below ``budget`` as the search finds.

    All lengths are taken at one rate as far as the last few longest documents' worth of words, and bounded-knapsack
    dynamic programming over the counts of what is free fills that rest. If it misses, twice as much is left to it, up to
    the last of SEARCHED; where that is the whole budget, the sum is the nearest there is.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    best = np.zeros(len(sizes), np.int64)
    if budget <= 0 or not total:
        return best
    if budget >= total:
        return counts.copy()
    for searched in SEARCHED:
        kept = max(0, budget - searched * int(sizes[counts > 0].max()))
        even = evenly(sizes, counts, kept)
        taken = even + filled(sizes, counts - even, budget - int((even * sizes).sum()))
        if int((taken * sizes).sum()) > int((best * sizes).sum()) or not best.any():
            best = taken
        if not kept or int((best * sizes).sum()) == budget:
            break
    return best


def evenly(sizes: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """Numbers of documents of each size, at one rate over the sizes in order, whose sum is within one document of ``words``."""
    order = np.argsort(sizes, kind="stable")
    total = int((sizes * counts).sum())
    before = np.concatenate(([0], np.cumsum(counts[order])))
    if int(before[-1]) * words < 1 << 62:
        reached = (2 * before * words + total) // (2 * total)
    else:
        reached = np.array([(2 * c * words + total) // (2 * total) for c in before.tolist()], np.int64)
    out = np.zeros(len(sizes), np.int64)
    out[order] = np.diff(reached)
    return out


def filled(sizes: np.ndarray, free: np.ndarray, left: int, seed: int = 5) -> np.ndarray:
    """Numbers of free documents of each size whose sum is the nearest below ``left``; sizes are tried in a seeded order."""
    taken = np.zeros(len(sizes), np.int64)
    usable = (free > 0) & (sizes > 0) & (sizes <= left)
    if not usable.any():
        return taken
    step_of = int(np.gcd.reduce(sizes[usable]))
    left //= step_of
    reached, by = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int32)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for k in np.random.default_rng(seed).permutation(np.flatnonzero(usable)).tolist():
        size = int(sizes[k]) // step_of
        rest, copies = min(int(free[k]), left // size), 1
        while rest > 0:
            copies = min(copies, rest)
            rest -= copies
            step = copies * size
            new = np.flatnonzero(reached[: left + 1 - step] & ~reached[step:]) + step
            by[new] = len(items)
            reached[new] = True
            items.append((k, copies))
            copies *= 2
        if reached[left]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        k, copies = items[by[at]]
        taken[k] += copies
        at -= copies * int(sizes[k]) // step_of
    return taken


def source_targets(sources: DataFrame, share: Fraction, most: int) -> DataFrame:
    """Adds ``target`` to ``sources`` (weight, source_size): shares of the budget by weight, stopped at ``most`` times the size.

    The excess is reshared among the others until none is above; sums are exact.
    """
    sources = checkpointed(sources)
    budget = share * int(sources.agg(F.coalesce(F.sum(F.col("source_size").cast("decimal(38,0)")), F.lit(0))).first()[0])
    level = None
    while True:
        if level is None:
            over = F.lit(False)
        else:
            over = most * F.col("source_size").cast("decimal(38,0)") * F.lit(level.denominator) < F.lit(level.numerator) * F.col("weight").cast("decimal(38,0)")
        held, weight = sources.agg(F.sum(F.when(over, most * F.col("source_size").cast("decimal(38,0)"))), F.sum(F.when(~over, F.col("weight")))).first()
        new = (budget - int(held or 0)) / int(weight) if weight else Fraction(0)
        if not weight or new == level:
            break
        level = new
    return sources.withColumn("target", F.when(over, (most * F.col("source_size")).cast("double")).otherwise(F.lit(float(level or 0)) * F.col("weight")))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 17) -> DataFrame:
    """(doc, size, source_size, target, copies): every row of ``docs`` as a struct, its words, and the times it is taken (0 to ``most``).

    ``docs`` has doc_id, source and text and must be stable when read twice. Sources, ordered by code point and null last, take
    ``weights`` in turn and share ``share`` of all words. Null or empty texts have size 0 and are taken as often as all of their
    source is. Of one length, the documents of smallest seeded hash of doc_id and text are taken; of rows that repeat, as
    many as are wanted. No text is shuffled unless there are more lengths than BROADCAST_LENGTHS. An empty table gives an
    empty result.
    """
    size = F.regexp_count(text_column(), F.lit(WORD)).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(text_column().cast("binary")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), key.alias("key"), size.alias("size"), hashed.alias("hash"))
    rows = rows.withColumn("group", F.shiftrightunsigned("hash", 64 - (GROUPS - 1).bit_length()).cast("int"))
    # texts are read here, and once more for the result
    sized = checkpointed(rows.select("key", "size", "group", "hash"))
    counts = checkpointed(sized.groupBy("key", "size", "group").agg(F.count("*").alias("n")))
    lengths = counts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = numbered(sources.withColumn("last", (F.col("key") == "").cast("int")), "last", "key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("row") % len(weights) + 1).cast("int"))
    sources = source_targets(sources.select("key", "source_size", weight.alias("weight")), share, most)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = min(most, int(target // total)) if total else 0
        extra = fit_budget(group["size"].to_numpy(), group["n"].to_numpy(), round(target) - whole * total if whole < most else 0)
        return group[["key", "size", "source_size", "target"]].assign(whole=whole, extra=extra)

    plan = lengths.join(sources, "key").groupBy("key").applyInPandas(fit, "key string, size long, source_size long, target double, whole int, extra long")
    # the group in which a length's last document is taken, and the hash of that document
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = counts.withColumn("before", earlier).join(plan, ["key", "size"]).filter((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("n")))
    edges = checkpointed(edges.select("key", "size", "group", (F.col("extra") - F.col("before")).alias("take")))
    at_edge = sized.join(_small(edges), ["key", "size", "group"]).groupBy("key", "size", "group", "take", "hash").agg(F.count("*").alias("alike"))
    up_to = F.sum("alike").over(Window.partitionBy("key", "size").orderBy("hash"))
    last = at_edge.withColumn("up_to", up_to).filter((F.col("up_to") - F.col("alike") < F.col("take")) & (F.col("take") <= F.col("up_to")))
    last = last.select("key", "size", F.col("group").alias("last_group"), F.col("hash").alias("last_hash"), F.when(F.col("take") < F.col("up_to"), F.col("take") - F.col("up_to") + F.col("alike")).alias("tied"))
    cuts = checkpointed(plan.join(last, ["key", "size"], "left"))
    found = rows.join(_small(cuts), ["key", "size"])
    before_last = (F.col("group") < F.col("last_group")) | (F.col("group") == F.col("last_group")) & (F.col("hash") < F.col("last_hash"))
    is_last = F.coalesce(F.col("hash") == F.col("last_hash"), F.lit(False))
    out = ["doc", "size", "source_size", "target"]
    if cuts.filter("tied is not null").isEmpty():
        return found.select(*out, (F.col("whole") + F.coalesce(before_last | is_last, F.lit(False)).cast("int")).alias("copies"))
    split = is_last & F.col("tied").isNotNull()
    clear = found.filter(~split).select(*out, (F.col("whole") + F.coalesce(before_last | is_last, F.lit(False)).cast("int")).alias("copies"))
    # rows that repeat the last document of a length: as many as are wanted, counted by stretches of rows
    alike = checkpointed(found.filter(split).select(*out, "key", "whole", "tied")).withColumn("at", F.monotonically_increasing_id())
    alike = alike.withColumn("stretch", F.shiftright("at", TIED_BITS))
    sums = alike.groupBy("key", "size", "stretch").agg(F.count("*").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = alike.join(sums, ["key", "size", "stretch"]).withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "stretch").orderBy("at")) + F.col("before"))
    return clear.unionByName(ranked.select(*out, (F.col("whole") + (F.col("rank") <= F.col("tied")).cast("int")).alias("copies")))


def _small(plan: DataFrame) -> DataFrame:
    """``plan`` to be broadcast, if it is small."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_LENGTHS else plan


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 17) -> DataFrame:
    """``docs`` with __size (words), __source_size, __target and __copies, the times that a row is taken (see ``mixture``).

    Columns of ``docs`` with these four names are replaced; all others are kept.
    """
    own = {f"__{c}": F.col(c) for c in ("size", "source_size", "target", "copies")}
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in own]
    return mixture(docs, weights, share, most, seed).select(*kept, *(c.alias(name) for name, c in own.items()))


def repeated(mixed: DataFrame) -> DataFrame:
    """The documents of ``mixture``, all their columns, each as often as it is taken."""
    each = F.explode(F.array_repeat("doc", F.col("copies").cast("int")))
    return mixed.filter("copies > 0").select(each.alias("doc")).select("doc.*")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixed_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))
