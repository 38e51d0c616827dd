"""Toxicity filter, near-duplicate removal, redaction, mixing and packing over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import mixing, ngram_join, packing, pii, toxicity
from chunkloom.llm._common import checkpointed, release, table

#: Ids that are broadcast at most (16 bytes each); more are joined by shuffling.
BROADCAST_IDS = 1 << 21


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, does not reject."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five-word shingles and 0.8, that of smallest doc_id; those without doc_id stay.

    Rows of one doc_id are one document: if the table repeats it, the row of the least text stays, null last (of rows
    alike in text, the least by a hash of the whole row), so reruns agree.
    """
    linked = ngram_join.link_components(docs, width=5, percent=80).filter("doc_id is not null")
    of_doc = linked.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("component"))
    # documents that go, and those of which one row stays: fewer, as a rule, than those that stay as they are
    special = checkpointed(of_doc.filter("rows > 1 or doc_id <> component"))
    release(spark)
    out = docs.join(_small(special), "doc_id", "left_anti").select(*docs.columns)
    again = special.filter("doc_id = component")
    if again.isEmpty():
        return out
    row = F.struct(*docs.columns)
    best = F.min_by(row, F.struct(F.col("text").isNull(), F.col("text"), F.xxhash64(row)))
    several = docs.join(_small(again), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("of")).agg(best.alias("row"))
    return out.unionByName(several.select("row.*"))


def _small(ids: DataFrame) -> DataFrame:
    """``ids`` to be broadcast, if there are at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars counted anew."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeated(mixing.mixture(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", redact), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared checkpoint folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
            release(spark)
    return docs
