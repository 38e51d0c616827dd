"""Tables and derived inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.split import split_content
from ..operators.chunk_maps import chunk_columns

SIZE, OVERLAP = 1300, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ``documents``: a file in its source's folder, language and source as metadata."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    parts = split_content(docs, "text", SIZE, OVERLAP)
    given = {c: F.col(c) for c in ("part", "total", "size", "overlap", "fromLine", "toLine", "content")}
    metadata = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    file = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return parts.select(*chunk_columns(id=F.concat(F.lit("doc"), F.col("doc_id").cast("string")), mimeType=F.lit("text/plain"), file=file, parent=F.col("source"), metadata=metadata, **given))


#: The chunks of ``documents`` in SQL, as a query named chunks; body is a part's text without prefix.
CHUNKS_SQL = """
w AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS len, lang, source, CASE WHEN length(coalesce(text, '')) < 1299 THEN 1 ELSE CAST(ceil(length(coalesce(text, '')) / 1199.0) AS INT) END AS total FROM documents),
x AS (SELECT *, CAST(unnest(range(0, total)) AS INT) AS part FROM w),
y AS (SELECT *, substr(text, 1 + part * 1199, 1299) AS body, CASE WHEN len < 1299 THEN 0 ELSE 100 END AS overlap FROM x),
z AS (SELECT *, CAST(length(body) - length(replace(body, chr(10), '')) AS INT) AS breaks FROM y),
chunks AS (SELECT 'doc' || doc_id AS id, doc_id, source || '/' || doc_id AS file, source AS parent, part, total, overlap, lang, source, body, chr(10) || body AS content, CAST(length(body) + 1 AS INT) AS size,
  CAST(1 + coalesce(sum(breaks) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS from_line, breaks FROM z)
"""
