"""Dependency edges between classes, resolution of names and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.split import split_pieces
from .chunk_maps import chunk_columns

# Headings of a dependency report, and its chunks' size and overlap.
USES_HEADING = "Die Klasse {} benutzt die folgenden Klassen:\n"
USED_BY_HEADING = "Die folgenden Klassen verweisen auf die Klasse {}:\n"
BULLET = "  * "
REPORT_SIZE, REPORT_OVERLAP = 600, 50


def dependency_edges(raw: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct (source, target) whose target starts with ``prefix``; null ends are dropped."""
    return raw.filter(F.col("source").isNotNull() & F.col("target").startswith(prefix)).select("source", "target").distinct()


def dependencies(edges: DataFrame) -> DataFrame:
    """(source, targets), sorted."""
    return edges.groupBy("source").agg(F.sort_array(F.collect_set("target")).alias("targets"))


def used_by(edges: DataFrame) -> DataFrame:
    """(target, sources), sorted."""
    return edges.groupBy("target").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def symbol_table(types: DataFrame) -> DataFrame:
    """(name, fqns): the full names that a simple name may stand for."""
    return types.groupBy("name").agg(F.sort_array(F.collect_set("fqn")).alias("fqns"))


def resolve_names(uses: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``fqn`` to ``uses`` (file, package, name).

    ``imports`` has (file, import, is_wildcard), a wildcard's import being its package; ``symbols`` has
    (name, fqn). In order: an import that is a candidate, a candidate in the file's package, a
    candidate in a package imported whole, else the name itself; a name without candidates gives ""; a
    file without package keeps the name. Of equals the first by name is taken.
    """
    keys = ["file", "package", "name"]
    uses = uses.select(*keys).distinct()
    explicit = imports.filter("not is_wildcard").select("file", F.col("import").alias("fqn"), F.lit(0).alias("p0"))
    whole = imports.filter("is_wildcard").select("file", F.col("import").alias("home"), F.lit(2).alias("p2")).distinct()
    found = uses.join(symbols.select("name", "fqn").distinct(), "name", "left")
    found = found.withColumn("home", F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1))
    found = found.join(explicit.distinct(), ["file", "fqn"], "left").join(whole, ["file", "home"], "left")
    same = F.when(F.col("fqn") == F.concat(F.col("package"), F.lit("."), F.col("name")), 1)
    rank = F.coalesce("p0", same, "p2")
    best = found.groupBy(*keys).agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("fqn").alias("fqn")))).alias("best"), F.count("fqn").alias("candidates"))
    fqn = F.when(F.coalesce(F.col("package"), F.lit("")) == "", F.col("name")).when(F.col("candidates") == 0, "").otherwise(F.coalesce(F.col("best.fqn"), F.col("name")))
    return best.select(*keys, fqn.alias("fqn"))


def dependency_reports(edges: DataFrame) -> DataFrame:
    """(source, content): what each class that uses others uses and is used by, as one text; see ``dependency_chunks`` for classes with very many users."""
    forward, backward = dependencies(edges), used_by(edges)
    both = forward.join(backward, forward["source"] == backward["target"], "left").select("source", "targets", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))

    def bullets(names: str):
        return F.array_join(F.transform(names, lambda x: F.concat(F.lit(BULLET), x, F.lit("\n"))), "")

    return both.select("source", F.concat(_heading(USES_HEADING), bullets("targets"), _heading(USED_BY_HEADING), bullets("sources")).alias("content"))


def _heading(text: str) -> Column:
    before, after = text.split("{}")
    return F.concat(F.lit(before), F.col("source"), F.lit(after))


def report_lines(edges: DataFrame) -> DataFrame:
    """(source, section, name, text): the lines of the reports, in the order of section and name; no class's users are gathered."""
    classes = edges.select("source").distinct()
    heads = [classes.select("source", F.lit(k).alias("section"), F.lit("").alias("name"), _heading(text).alias("text")) for k, text in ((0, USES_HEADING), (2, USED_BY_HEADING))]
    line = F.concat(F.lit(BULLET), F.col("name"), F.lit("\n")).alias("text")
    uses = edges.select("source", F.lit(1).alias("section"), F.col("target").alias("name")).distinct()
    users = edges.select(F.col("target").alias("source"), F.lit(3).alias("section"), F.col("source").alias("name")).distinct().join(classes, "source", "left_semi")
    return heads[0].unionByName(heads[1]).unionByName(uses.select("*", line)).unionByName(users.select("*", line))


def dependency_chunks(edges: DataFrame, size: int = REPORT_SIZE, overlap: int = REPORT_OVERLAP) -> DataFrame:
    """Chunks of the reports; the end line of a report in one part is its number of characters.

    A report is cut from its lines, so that one of a class that everything uses is never a single value.
    """
    parts = split_pieces(report_lines(edges), ["source"], ["section", "name"], size, overlap, from_line=0)
    given = {c: F.col(c) for c in ("part", "total", "size", "overlap", "fromLine", "toLine", "content")}
    metadata = F.create_map(F.lit("java_code_section"), F.lit("dependenciesInfo"))
    return parts.select(*chunk_columns(id=F.concat("source", F.lit(".dependencies")), mimeType=F.lit("text/plain"), parent=F.col("source"), metadata=metadata, **given))
