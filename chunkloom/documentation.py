"""Doc comments for methods that have none, asked from a chat model."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import clean_doc_comment, doc_comment, is_doc_comment
from .operators import java, prompt, retrieval
from .sources.jsonl import unwritten, write_sources

# Seconds between two calls of a chat model.
LEAST_WAIT = 5.0
FOOTER = "Hinweis: Diese Doku wurde generiert mit dem ChatModel {}"


def document_project(spark: SparkSession, files: DataFrame, store: DataFrame, embedder: retrieval.Embedder, chat: prompt.Chat, out: str, model: str = "none", wait: float = LEAST_WAIT, most: int | None = None) -> DataFrame:
    """Ask for each undocumented method, write the changed sources below ``out``; returns (file, line, id, comment).

    Calls are made by the driver one at a time, at least ``wait`` seconds apart, as chat services ask for.
    Files that exist below ``out`` are skipped; answers that are no doc comment are left out.
    """
    missing = java.undocumented_methods(java.scan(unwritten(files, out))).orderBy("file", "line")
    answers, last = [], float("-inf")
    for row in (missing if most is None else missing.limit(most)).toLocalIterator():
        time.sleep(max(0.0, last + wait - time.monotonic()))
        last = time.monotonic()
        question = prompt.DOC_QUESTION.replace("{}", row["signature"], 1).replace("{}", row["class"], 1)
        name = " " + row["signature"].split("(")[0].rsplit(" ", 1)[-1] + "("
        answer = prompt.ask(spark, store, question, embedder, chat, validators=[prompt.mentions(row["class"], name)], prefetched=retrieval.find_by_id(store, row["id"]))
        answers.append((row["file"], row["line"], row["id"], answer))
    rows = spark.createDataFrame(answers, "file string, line int, id string, answer string").withColumn("answer", doc_comment(F.col("answer"))).filter(is_doc_comment(F.col("answer")))
    body = clean_doc_comment(F.col("answer"), FOOTER.format(model))
    lines = F.transform(F.split(F.rtrim(F.regexp_replace(body, r"^\n+|\s+$", "")), "\n"), lambda x: F.rtrim(F.concat(F.lit("     * "), F.regexp_replace(x, r"^[ *]+", ""))))
    rows = rows.select("file", "line", "id", F.concat(F.lit("    /**\n"), F.array_join(lines, "\n"), F.lit("\n     */")).alias("comment"))
    write_sources(java.documented(files, rows), out)
    return rows
