"""Queries that split, recombine, encode and filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_doc_comment, doc_comment, extension, file_type, has_text, is_doc_comment, line_range, method_name, simple_method_name
from ..functions.split import combine, split_content, unsplit
from ..operators.chunk_maps import chunk_from_map, flat_map
from ..operators.numbering import batches
from ..operators.vetoes import hidden, image, in_build_folder, not_listed, standard_vetoes, too_long, vetoed
from ..schema import FILE_TYPES
from ..sources import jsonl
from .common import CHUNKS_SQL, OVERLAP, SIZE, document_chunks, table

WHITE_LIST = "html,php,txt"


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", SIZE, OVERLAP)
    return parts.select("doc_id", "part", "total", "size", "overlap", "content")


def split_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    parts = split_content(rows, "text", 200, 20, F.concat(F.lit("//"), "role"))
    return parts.select("conv_id", "turn", "part", "total", "size", "overlap", "content")


def split_small_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_content(table(spark, sf_dir, "pages").select("page_id", "html"), "html", 600, 50)
    return parts.select("page_id", "part", "total", "overlap", F.md5("content").alias("content_md5"))


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", SIZE, OVERLAP)
    return parts.select("doc_id", "part", F.col("fromLine").alias("from_line"), F.col("toLine").alias("to_line"))


def unsplit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", SIZE, OVERLAP)
    return unsplit(parts, "doc_id").select("doc_id", "parts", F.md5("content").alias("text_md5"))


def combine_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = combine(document_chunks(spark, sf_dir))
    return whole.select("id", "file", "parent", "part", "total", "size", "overlap", F.col("fromLine").alias("from_line"), F.col("metadata")["lang"].alias("lang"), F.md5("content").alias("content_md5"))


def chunk_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_chunks(spark, sf_dir).select("id", "part", F.array_sort(F.map_entries(flat_map())).alias("e"))
    return rows.select("id", "part", F.array_join(F.transform("e", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("flat"))


def chunk_roundtrip_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = document_chunks(spark, sf_dir).select(flat_map().alias("m"), "content")
    rows = flat.select(*chunk_from_map("m", "content"))
    return rows.select("id", "file", "parent", "part", "total", "size", "overlap", F.col("metadata")["lang"].alias("lang"), F.md5("content").alias("content_md5"))


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jsonl.decode(jsonl.to_lines(document_chunks(spark, sf_dir)))
    return rows.select("id", "part", "total", "size", "overlap", F.col("metadata")["source"].alias("source"), F.md5("content").alias("content_md5"))


def jsonl_malformed_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 10 == 0, F.substring("props", F.lit(1), F.length("props") - 1)).when(F.col("event_id") % 10 == 1, F.lit("  ")).otherwise(F.col("props"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("more", T.StringType())])
    return jsonl.decode(table(spark, sf_dir, "events").select("event_id", line.alias("value")), schema, keep=("event_id",))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("length"))


def veto_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path, length = _pages(spark, sf_dir), F.col("path"), F.col("length")
    return pages.select("page_id", in_build_folder(path, length).alias("build"), too_long(2000)(path, length).alias("too_long"), hidden(path, length).alias("hidden"), image(path, length).alias("image"), vetoed(standard_vetoes(most=2000)).alias("vetoed"))


def whitelist_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path, length = _pages(spark, sf_dir), F.col("path"), F.col("length")
    return pages.select("page_id", extension(path).alias("ending"), (~not_listed(WHITE_LIST)(path, length)).alias("listed"), (~not_listed(WHITE_LIST, compat=True)(path, length)).alias("contained"))


def file_type_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", file_type(F.col("path")).alias("file_type"))


def chunkers_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunker whose suffix matches; the chunkers are a fixed short list."""
    known = spark.createDataFrame([(n, s) for n, s in FILE_TYPES] + [("ANY_PAGE", "l"), ("ANY", "")], "chunker string, suffix string")
    pages = _pages(spark, sf_dir)
    return pages.join(F.broadcast(known), pages["path"].endswith(known["suffix"])).select("page_id", "chunker")


def text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines of each document, and the parts of a method's name made of its columns."""
    docs, first = table(spark, sf_dir, "documents"), (F.col("doc_id") % 4).cast("int")
    method = F.concat(F.col("lang"), F.lit(" get"), F.col("doc_id").cast("string"), F.lit("(a."), F.col("lang"), F.lit(")"))
    names = [method_name(F.concat("source", F.lit("."), method), F.col("source")).alias("method"), simple_method_name(F.concat(F.lit("public "), method)).alias("simple")]
    return docs.select("doc_id", F.md5(line_range(F.coalesce("text", F.lit("")), first, first + 2)).alias("lines_md5"), *names)


def has_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(has_text(F.col("text"))).groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def batches_of_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id")


_ANSWER = "Hier die Doku: /**\n * Turn {} of {}.\n * @return nothing\n */ Ende."


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, middle, after = _ANSWER.split("{}")
    own = F.concat(F.lit(before), F.col("turn").cast("string"), F.lit(middle), F.col("role"), F.lit(after))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, own).otherwise("no comment").alias("answer"))


def javadoc_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = doc_comment(F.col("answer"))
    return _answers(spark, sf_dir).select("conv_id", "turn", found.alias("comment"), is_doc_comment(found).alias("is_comment"))


def javadoc_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer's doc comment made clean; answers without one have no text."""
    found = doc_comment(F.col("answer"))
    return _answers(spark, sf_dir).select("conv_id", "turn", F.when(is_doc_comment(found), clean_doc_comment(found, "Made by a model")).alias("text"))


QUERIES = {f.__name__: f for f in (split_documents, split_prefixed, split_small_windows, part_lines, unsplit_roundtrip, combine_units, chunk_flat_map, chunk_roundtrip_map, jsonl_roundtrip, jsonl_malformed_dropped, veto_pages, whitelist_suffix, file_type_of_path, chunkers_of_file, text_places, has_text_filter, batches_of_50, javadoc_extract, javadoc_sanitize)}

_CASES = " ".join(f"WHEN suffix(url, '{s}') THEN '{n}'" for n, s in FILE_TYPES)
_URL_NAME = "regexp_extract(url, '[^/]*$')"
_ENDING = "CASE WHEN instr(url, '.') = 0 THEN url ELSE regexp_extract(url, '[^.]*$') END"
_VETOES = {"build": "(contains(url, 'target') OR contains(url, 'build'))", "too_long": "(strlen(coalesce(html, '')) > 2000)", "hidden": f"starts_with({_URL_NAME}, '.')", "image": "(suffix(url, '.png') OR suffix(url, '.jpg') OR suffix(url, '.jpeg'))"}
ORACLE_SQL = {
    "split_documents": f"WITH {CHUNKS_SQL} SELECT doc_id, part, total, size, overlap, content FROM chunks",
    "split_prefixed": """
WITH w AS (SELECT conv_id, turn, '//' || role AS prefix, text, length(text) AS len, 199 - length('//' || role) AS act FROM conversations),
v AS (SELECT *, CASE WHEN len < act THEN 1 ELSE CAST(ceil(len / CAST(act - 20 AS DOUBLE)) AS INT) END AS total FROM w),
x AS (SELECT *, CAST(unnest(range(0, total)) AS INT) AS part FROM v),
y AS (SELECT *, prefix || chr(10) || substr(text, 1 + part * (act - 20), act) AS content FROM x)
SELECT conv_id, turn, part, total, CAST(length(content) AS INT) AS size, CASE WHEN len < act THEN 0 ELSE 20 END AS overlap, content FROM y""",
    "split_small_windows": """
WITH w AS (SELECT page_id, coalesce(html, '') AS html, length(coalesce(html, '')) AS len FROM pages),
v AS (SELECT *, CASE WHEN len < 599 THEN 1 ELSE CAST(ceil(len / 549.0) AS INT) END AS total FROM w),
x AS (SELECT *, CAST(unnest(range(0, total)) AS INT) AS part FROM v)
SELECT page_id, part, total, CASE WHEN len < 599 THEN 0 ELSE 50 END AS overlap, md5(chr(10) || substr(html, 1 + part * 549, 599)) AS content_md5 FROM x""",
    "part_lines": f"WITH {CHUNKS_SQL} SELECT doc_id, part, CAST(from_line AS VARCHAR) AS from_line, CAST(from_line + breaks AS VARCHAR) AS to_line FROM chunks",
    "unsplit_roundtrip": "SELECT doc_id, CASE WHEN length(text) < 1299 THEN 1 ELSE CAST(ceil(length(text) / 1199.0) AS INT) END AS parts, md5(text) AS text_md5 FROM documents",
    "combine_units": f"WITH {CHUNKS_SQL} SELECT c.id, c.file, c.parent, 0 AS part, 0 AS total, c.size, c.overlap, CAST(c.from_line AS VARCHAR) AS from_line, c.lang, md5(d.text) AS content_md5 FROM chunks c JOIN documents d USING (doc_id) WHERE c.part = 0",
    "chunk_flat_map": f"WITH {CHUNKS_SQL} SELECT id, part, 'chunk_file=' || file || ';chunk_fromLine=' || from_line || ';chunk_id=' || id || ';chunk_metadata.lang=' || lang || ';chunk_metadata.source=' || source || ';chunk_mimeType=text/plain;chunk_overlap=' || overlap || ';chunk_parent=' || parent || ';chunk_part=' || part || ';chunk_size=' || size || ';chunk_toLine=' || (from_line + breaks) || ';chunk_total=' || total AS flat FROM chunks",
    "chunk_roundtrip_map": f"WITH {CHUNKS_SQL} SELECT id, file, parent, part, total, size, overlap, lang, md5(content) AS content_md5 FROM chunks",
    "jsonl_roundtrip": f"WITH {CHUNKS_SQL} SELECT id, part, total, size, overlap, source, md5(content) AS content_md5 FROM chunks",
    "jsonl_malformed_dropped": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS more FROM events WHERE event_id % 10 NOT IN (0, 1)",
    "veto_pages": f"SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _VETOES.items())}, ({' OR '.join(_VETOES.values())}) AS vetoed FROM pages",
    "whitelist_suffix": f"SELECT page_id, {_ENDING} AS ending, ({_ENDING}) IN ('html', 'php', 'txt') AS listed, contains('{WHITE_LIST}', {_ENDING}) AS contained FROM pages",
    "file_type_of_path": f"SELECT page_id, CASE {_CASES} ELSE 'UNKNOWN' END AS file_type FROM pages",
    "chunkers_of_file": "SELECT page_id, c.chunker FROM pages JOIN (VALUES " + ", ".join(f"('{n}', '{s}')" for n, s in [*FILE_TYPES, ("ANY_PAGE", "l"), ("ANY", "")]) + ") c(chunker, suffix) ON suffix(url, c.suffix)",
    "text_places": """WITH l AS (SELECT *, list_slice(string_split(coalesce(text, ''), chr(10)), 1 + doc_id % 4, 3 + doc_id % 4) AS l FROM documents)
SELECT doc_id, md5(CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) || chr(10) ELSE '' END) AS lines_md5, lang || ' get' || doc_id || '(a.' || lang || ')' AS method, ' get' || doc_id || '(' AS simple FROM l""",
    "has_text_filter": r"SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE regexp_matches(text, '\S') GROUP BY role",
    "batches_of_50": "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 50 AS BIGINT) AS batch FROM documents",
    "javadoc_extract": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '/**' || chr(10) || ' * Turn ' || turn || ' of ' || role || '.' || chr(10) || ' * @return nothing' || chr(10) || ' */' ELSE 'no comment' END AS comment, turn % 2 = 0 AS is_comment FROM conversations",
    "javadoc_sanitize": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN chr(10) || '    Turn ' || turn || ' of ' || role || '.' || chr(10) || '    @return nothing' || chr(10) || chr(10) || '    Made by a model' || chr(10) || chr(10) END AS text FROM conversations",
}
