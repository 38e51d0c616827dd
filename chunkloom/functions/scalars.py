"""Scalar functions on strings and vectors, all within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FILE_TYPES, SECTIONS, SECTION_WEIGHTS


def has_text(c: Column) -> Column:
    """True where there is a character that is not white space; null counts as no text."""
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def count_of(c: Column, literal: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def after_first_line(c: Column) -> Column:
    """The text after the first line break, the whole text if it has none."""
    return F.substring(c, F.instr(c, "\n") + 1, F.length(c))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The text after the last dot, the whole text if it has none."""
    return F.substring_index(path, ".", -1)


def file_type(path: Column) -> Column:
    out = F.lit("UNKNOWN")
    for name, suffix in reversed(FILE_TYPES):
        out = F.when(path.endswith(suffix), name).otherwise(out)
    return out


def section_of(name: Column) -> Column:
    """A known section's name, else unknown."""
    return F.when(name.isin(*SECTIONS), name).otherwise("unknown")


def section_weight(name: Column) -> Column:
    out = F.lit(0)
    for section, weight in SECTION_WEIGHTS.items():
        out = F.when(name == section, weight).otherwise(out)
    return out


def method_name(chunk_id: Column, class_id: Column | None = None) -> Column:
    """The signature in a method's id: what follows its class, or else the last dot."""
    last = F.substring_index(chunk_id, ".", -1)
    if class_id is None:
        return last
    return F.when(chunk_id.startswith(F.concat(class_id, F.lit("."))), F.substring(chunk_id, F.length(class_id) + 2, F.length(chunk_id))).otherwise(last)


def simple_method_name(declaration: Column) -> Column:
    """A declaration's name with the space before and the opening bracket."""
    return F.regexp_extract(declaration, r"( [^ (]*\()", 1)


def insert_before(text: Column, mark: Column, addition: Column) -> Column:
    """``addition`` put before the first ``mark``; unchanged where there is none."""
    at = F.position(mark, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), addition, F.substring(text, at, F.length(text)))).otherwise(text)


def path_from_source_root(path: Column, root: str = "src") -> Column:
    """The path from the first ``root`` on, else the file's name."""
    at = F.instr(path, root)
    return F.when(at > 0, F.substring(path, at, F.length(path))).otherwise(file_name(path))


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, counted from 0, both included, as far as there are any; each ends with a line break."""
    lines = F.slice(F.split(text, "\n", -1), first + 1, F.greatest(last - first + 1, F.lit(0)))
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def doc_comment(answer: Column) -> Column:
    """From the first ``/**`` to the last ``*/`` of a text, the text itself if it has no such part."""
    found = F.regexp_extract(answer, r"(?s)/\*\*.*\*/", 0)
    return F.when(found == "", answer).otherwise(found)


def is_doc_comment(answer: Column) -> Column:
    return F.coalesce(has_text(answer) & answer.startswith("/**") & answer.endswith("*/"), F.lit(False))


def clean_doc_comment(comment: Column, footer: str) -> Column:
    """A comment's text without its frame, indented and closed by ``footer``."""
    lines = F.transform(F.split(F.regexp_replace(comment, r"\r\n?", "\n"), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    kept = F.filter(lines, lambda x: x != "*/")
    body = F.array_join(F.transform(kept, lambda x: F.when(x == "/**", "\n").otherwise(F.concat(F.lit("     "), x, F.lit("\n")))), "")
    out = F.concat(body, F.lit(f"     *\n     * {footer}\n     *\n"))
    for literal in (" * ", "/**", "*/"):
        out = F.replace(out, F.lit(literal), F.lit(""))
    return F.replace(out, F.lit("     *\n"), F.lit("\n"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def relevance(a: Column, b: Column) -> Column:
    """Cosine, moved from -1..1 to 0..1."""
    return (1 + dot(a, b) / (norm(a) * norm(b))) / 2
