"""Hits and their ancestors as trees: roots, ranks and order of visit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import section_of, section_weight
from .numbering import checkpointed

#: Levels that are climbed one by one before chains that go on are climbed by doubling.
WALKED = 4


def ancestor_closure(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(hit_id, node_id, parent_id, section, depth) of each distinct hit and its existing ancestors.

    ``chunks`` has id, parent and section. depth is 0 at the hit. A parent that does not exist
    ends the chain, and so does one seen before. Hits that do not exist are dropped. The first levels look their nodes up by one
    semi-join of ``chunks`` each, which does not shuffle it where the level is small; chains that are longer are climbed by
    pointer doubling, in as many rounds as their length has binary digits.
    """

    def nodes(ids: DataFrame) -> DataFrame:
        own = chunks.join(ids.distinct(), "id", "left_semi")
        first = F.min(F.struct(F.nullif(F.col("parent"), F.lit("")).alias("parent"), F.col("section").alias("section")))
        return own.groupBy("id").agg(first.alias("n")).select("id", "n.parent", "n.section")

    level = nodes(hits.select("id")).select(F.col("id").alias("hit_id"), F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), "section", F.lit(0).alias("depth"), F.array("id").alias("seen"))
    level = checkpointed(level)
    out = level
    above = level.filter("parent_id is not null and not array_contains(seen, parent_id)")
    for depth in range(1, WALKED + 1):
        if above.isEmpty():
            return out.drop("seen")
        up = above.select("hit_id", "parent_id", "seen")
        up = up.join(nodes(up.select(F.col("parent_id").alias("id"))), F.col("parent_id") == F.col("id"))
        level = checkpointed(up.select("hit_id", F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), "section", F.lit(depth).alias("depth"), F.concat("seen", F.array("id")).alias("seen")))
        out = out.unionByName(level)
        above = level.filter("parent_id is not null and not array_contains(seen, parent_id)")
    if above.isEmpty():
        return out.drop("seen")
    further = _by_doubling(above, chunks)
    # a chain that bends back into the levels walked has seen those nodes already
    further = further.join(out.select("hit_id", "node_id"), ["hit_id", "node_id"], "left_anti").withColumn("depth", F.col("depth") + WALKED)
    further = checkpointed(further)
    known = nodes(further.select(F.col("node_id").alias("id"))).select(F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), "section")
    return out.drop("seen").unionByName(further.join(known, "node_id"))


def _by_doubling(starts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(hit_id, node_id, depth): the ancestors of each start's node (hit_id, node_id), the parent having depth 1.

    Before a round, ``reached`` holds the ancestors up to depth 2 ** k and ``jump`` leads each node to its ancestor of
    depth 2 ** k, if it has one. A round without a node that is new for its hit is the last one: the chain has ended or closed.
    """
    parents = chunks.groupBy("id").agg(F.min(F.struct(F.nullif(F.col("parent"), F.lit("")).alias("parent"), "section")).alias("n")).select("id", F.col("n.parent").alias("to"))
    parents = checkpointed(parents)
    jump = checkpointed(parents.join(parents.select(F.col("id").alias("to")), "to").select("id", "to"))
    reached = checkpointed(starts.join(jump, F.col("node_id") == F.col("id")).select("hit_id", F.col("to").alias("node_id"), F.lit(1).alias("depth")))
    size, step = reached.count(), 1
    while True:
        more = reached.join(jump, F.col("node_id") == F.col("id")).select("hit_id", F.col("to").alias("node_id"), (F.col("depth") + step).alias("depth"))
        reached = checkpointed(reached.unionByName(more).groupBy("hit_id", "node_id").agg(F.min("depth").alias("depth")))
        before, size = size, reached.count()
        if size == before:
            return reached
        jump = checkpointed(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("beyond")), "to").select("id", F.col("beyond").alias("to")))
        step *= 2


def roots(closure: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, hit_id, root_id): each hit's highest existing ancestor, or itself."""
    return closure.groupBy(*keys, "hit_id").agg(F.max_by("node_id", "depth").alias("root_id"))


def tree_ranks(closure: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, root_id, rank, hits): the weights of a tree's hits added up, each hit once."""
    own = closure.filter("depth = 0").select(*keys, "hit_id", section_weight(section_of(F.col("section"))).alias("weight"))
    return roots(closure, keys).join(own, [*keys, "hit_id"]).groupBy(*keys, "root_id").agg(F.sum("weight").cast("long").alias("rank"), F.count("*").alias("hits"))


def forest(closure: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, root_id, node_id, section, path): every node of every tree once; sorted by path, a tree is in order of visit."""
    tops = roots(closure, keys)
    height = closure.groupBy(*keys, "hit_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("order"), "node_id"))).alias("line"))
    line = height.select(*keys, "hit_id", F.transform("line", lambda x: x["node_id"]).alias("line"))
    nodes = closure.join(line, [*keys, "hit_id"]).join(tops, [*keys, "hit_id"])
    place = F.array_position("line", F.col("node_id")).cast("int")
    nodes = nodes.select(*keys, "root_id", "node_id", "section", F.slice("line", 1, place).alias("path"))
    return nodes.groupBy(*keys, "root_id", "node_id").agg(F.min("path").alias("path"), F.min("section").alias("section"))


def forest_roots(closure: DataFrame) -> DataFrame:
    return roots(closure).select("root_id").distinct()
