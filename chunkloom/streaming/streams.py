"""Streams of chunk lines and of prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import has_text
from ..operators import prompt
from ..operators.numbering import checkpointed
from ..operators.retrieval import BATCH, Embedder, embedded
from ..operators.store import ChunkStore
from ..sources.jsonl import decode


def chunk_lines(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """Chunks of the JSONL files that arrive in ``folder``; malformed lines are dropped."""
    return decode(spark.readStream.option("maxFilesPerTrigger", files_each).text(folder))


def embed_incrementally(chunks: DataFrame, store: ChunkStore, embedder: Embedder, checkpoint: str, batch: int = BATCH) -> StreamingQuery:
    """Append new chunks to ``store`` batch by batch.

    Each batch is compared with the store as it is before the batch, and its parts are taken once, so a batch
    that is run again after a failure adds nothing twice.
    """
    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: store.add(rows.dropDuplicates(["id", "part"]), embedder, batch)).trigger(availableNow=True).start()


def prompts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Prompts without blank ones and the word that ends a session."""
    text = F.col(column)
    return lines.filter(has_text(text) & (F.lower(F.trim(text)) != "exit"))


def answer_batches(lines: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, column: str = "value") -> StreamingQuery:
    """Write what ``answer`` makes of each batch of prompts below ``path``; a batch that runs again replaces its own rows.

    Answers are made by the executors, for any number of prompts.
    """

    def handle(rows: DataFrame, batch: int) -> None:
        answer(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return prompts(lines, column).writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()


def enrich_batches(lines: DataFrame, store: DataFrame, embedder: Embedder, path: str, checkpoint: str, column: str = "value", **how) -> StreamingQuery:
    """Write the enriched form of every prompt of a stream, (question, prompt, level, trees), with the chunks of ``store`` as context.

    A batch's prompts are embedded in the executors and searched together, under numbers, which are shorter than they; the same words asked
    twice in a batch are enriched once and written twice. ``how`` goes to ``prompt.enrich_many``.
    """

    def answer(rows: DataFrame) -> DataFrame:
        asked = rows.groupBy(F.col(column).alias("question")).agg(F.count("*").alias("times"))
        asked = checkpointed(embedded(asked, embedder, column="question").withColumn("question_id", F.monotonically_increasing_id()))
        told = prompt.enrich_many(asked, store, **how).join(asked.select("question_id", "question", "times"), "question_id")
        return told.select("question", "prompt", "level", "trees", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")

    return answer_batches(lines, answer, path, checkpoint, column)


def answer_prompts(lines: DataFrame, enrich: Callable[[str], str], sink: Callable[[str, str], None], checkpoint: str, column: str = "value") -> StreamingQuery:
    """Call ``sink`` with each prompt and its enriched form, in order of arrival within a batch.

    For a console: the driver handles one prompt after the other. See ``enrich_batches`` for many.
    """

    def handle(rows: DataFrame, _: int) -> None:
        for row in rows.toLocalIterator():
            sink(row[column], enrich(row[column]))

    return prompts(lines, column).writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()
