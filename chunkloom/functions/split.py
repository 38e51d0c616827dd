"""Splitting of texts into overlapping windows, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import checkpointed, running_sums
from ..schema import CHUNK_COLUMNS
from .scalars import after_first_line, count_of


def split_content(df: DataFrame, content: str | Column, size: int, overlap: int, prefix: str | Column = "", from_line: Column | int = 1, to_line: Column | None = None, compat_lines: bool = False) -> DataFrame:
    """One row for each window of ``content``, with part, total, size, overlap, content, fromLine and toLine.

    A window holds size - length(prefix) - 1 characters and starts that many less ``overlap`` after the
    one before; a shorter text is one part without overlap. Each part's content is the prefix, a line
    break and the window. Start lines add up the line breaks of the windows before, so overlaps count
    twice; ``compat_lines`` writes a part's end line as its start line followed by its number of
    line breaks, digits beside digits. Null content is empty. A window not larger than the
    overlap raises ValueError, or an error of the query where the prefix is a column.
    Columns of ``df`` with the new names are replaced.
    """
    text = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    if isinstance(prefix, str):
        if size - len(prefix) - 1 <= overlap:
            raise ValueError(f"windows of {size - len(prefix) - 1} characters cannot overlap by {overlap}")
        prefix = F.lit(prefix)
        window = size - F.length(prefix) - 1
    else:
        prefix = F.coalesce(prefix, F.lit(""))
        window = size - F.length(prefix) - 1
        window = F.when(window > overlap, window).otherwise(F.raise_error(F.lit("window not larger than overlap")).cast("int"))
    first = F.lit(from_line) if isinstance(from_line, int) else from_line
    df = df.withColumns({"__text": text, "__prefix": prefix, "__window": window, "__first": first.cast("int"), "__last": (to_line if to_line is not None else first + count_of(text, "\n")).cast("string")})
    alone = F.length("__text") < F.col("__window")
    total = F.when(alone, 1).otherwise(F.ceil(F.length("__text") / (F.col("__window") - overlap)).cast("int"))
    bodies = F.transform(F.sequence(F.lit(0), F.col("total") - 1), lambda i: F.substring(F.col("__text"), i * (F.col("__window") - overlap) + 1, F.col("__window")))
    df = df.withColumns({"total": total, "__alone": alone}).withColumn("__bodies", bodies).withColumn("__breaks", F.transform("__bodies", lambda b: count_of(b, "\n")))
    # rows after the explosion carry the numbers of line breaks, but neither the text nor the other parts
    df = df.select("*", F.posexplode("__bodies").alias("part", "__body")).drop("__bodies", "__text", "__window")
    start = F.col("__first") + F.aggregate(F.slice("__breaks", 1, F.col("part")), F.lit(0), lambda s, x: s + x)
    own = F.element_at("__breaks", F.col("part") + 1)
    end = F.concat(start.cast("string"), own.cast("string")) if compat_lines else (start + own).cast("string")
    content_column = F.concat("__prefix", F.lit("\n"), "__body")
    single = (F.col("total") == 1) & F.col("__alone")
    out = {"content": content_column, "size": F.length(content_column), "overlap": F.when(single, 0).otherwise(overlap), "fromLine": start.cast("string"), "toLine": F.when(single, F.col("__last")).otherwise(end)}
    return df.withColumns(out).drop("__prefix", "__first", "__last", "__alone", "__breaks", "__body")


def split_pieces(pieces: DataFrame, keys: list[str], order: list[str], size: int, overlap: int, from_line: int = 1, text: str = "text") -> DataFrame:
    """The windows of ``split_content`` for texts that stand in pieces: rows of ``keys`` in the order of ``order``, each with a part of the text.

    No text is put together whole: a piece goes to the windows that it reaches, and only a window's pieces are gathered. The end line of a text of
    one window is its number of characters. Keys must not be null; a text must have a character.
    """
    window = size - 1
    if window <= overlap:
        raise ValueError(f"windows of {window} characters cannot overlap by {overlap}")
    step = window - overlap
    pieces = checkpointed(pieces.select(*keys, *order, F.col(text).alias("__text")))
    rows = running_sums(pieces, F.length("__text"), keys, order, "__at").filter(F.length("__text") > 0)
    end = F.col("__at") + F.length("__text")
    windows = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("__at") + 1 - window) / step)), F.floor((end - 1) / step))
    rows = rows.select("*", F.explode(windows.cast("array<int>")).alias("part"))
    first = F.greatest(F.col("__at"), F.col("part") * step)
    own = F.substring("__text", (first - F.col("__at") + 1).cast("int"), (F.least(end, F.col("part") * step + window) - first).cast("int"))
    parts = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("__at", own.alias("s")))).alias("__s"))
    parts = parts.withColumn("__body", F.array_join(F.transform("__s", lambda x: x["s"]), "")).drop("__s")
    totals = pieces.groupBy(*keys).agg(F.sum(F.length("__text")).alias("__length"))
    parts = checkpointed(parts.join(totals, keys).withColumn("__alone", F.col("__length") < window).filter("part = 0 or not __alone"))
    parts = running_sums(parts.withColumn("__breaks", count_of(F.col("__body"), "\n")), F.col("__breaks"), keys, ["part"], "__before")
    start, content = (F.col("__before") + from_line).cast("int"), F.concat(F.lit("\n"), F.col("__body"))
    total = F.when(F.col("__alone"), 1).otherwise(F.ceil(F.col("__length") / step)).cast("int")
    last = F.when(F.col("__alone"), F.col("__length")).otherwise(start + F.col("__breaks"))
    out = {"total": total, "size": F.length(content), "overlap": F.when(F.col("__alone"), 0).otherwise(overlap), "fromLine": start.cast("string"), "toLine": last.cast("string"), "content": content}
    return parts.select(*keys, "part", *(c.alias(n) for n, c in out.items()))


def _joined(parts: Column) -> Column:
    """The text of sorted (part, overlap, content) structs."""
    bodies = F.transform(parts, lambda p: F.struct(p["overlap"].alias("overlap"), after_first_line(p["content"]).alias("body")))
    rest = F.transform(bodies, lambda p, i: F.when(i == 0, p["body"]).when(F.length(p["body"]) > p["overlap"], F.substring(p["body"], p["overlap"] + 1, F.length(p["body"]))).otherwise(""))
    return F.array_join(rest, "")


def unsplit(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, content, parts): each unit's text put together again from its parts, without their prefixes."""
    parts = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "overlap", "content"))).alias("__parts"))
    return parts.select(*keys, _joined(F.col("__parts")).alias("content"), F.size("__parts").alias("parts"))


def combine(chunks: DataFrame) -> DataFrame:
    """One chunk for each id: the joined text, every other attribute of the lowest part, part and total 0.

    A part that occurs twice counts once. A chunk without id is dropped.
    """
    others = [c for c in CHUNK_COLUMNS if c not in ("id", "part", "overlap", "content", "metadata", "total")]
    row = F.struct("part", "overlap", "content", *others, F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("entries"))
    parts = chunks.filter("id is not null").dropDuplicates(["id", "part"]).groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("__parts"))
    first = F.element_at("__parts", 1)
    kept = {c: first[c] for c in others} | {"overlap": first["overlap"], "metadata": F.map_from_entries(first["entries"]), "part": F.lit(0), "total": F.lit(0), "content": _joined(F.col("__parts"))}
    return parts.select("id", *(c.alias(n) for n, c in kept.items())).select(*CHUNK_COLUMNS)
