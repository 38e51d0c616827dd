"""Language of web pages by fusing evidence.

The text's likelihood in each language, the language that the markup declares, the address's
suffix and its host are combined by Bayes' rule. How reliable declarations are, and what hosts
and suffixes say, is counted over all pages by grouped aggregation of the text's own
posteriors; a host's prior is smoothed towards its suffix's, and that towards all pages'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpointed, frugal, sample_table, sliced, small_batches, table, text_column
from ._words import sentence_words, word_features

BITS, GRAMS = 16, (2, 3, 4)
#: Documents of known language that the text model is counted on, at most.
SAMPLE = 2000
#: Documents of a language, at least, if it has them.
EACH = 50
#: Pages that a suffix's and all pages' shares weigh against a host's, and a suffix's own.
SMOOTHING = 5.0
#: Copies of the host table against hot hosts.
SALTS = 16
#: A text's evidence is tempered: all its words are read, and their mean counts as that of so many words at most, since words of one text are not independent.
EVIDENCE = 60.0


class TextModel:
    """Log-probabilities of hashed features of words by language."""

    def __init__(self, languages: list[str], texts: list[str], labels: list[str], evidence: float = EVIDENCE):
        self.languages, self.evidence = languages, evidence
        counts = np.full((len(languages), 1 << BITS), 0.1)
        rows = np.array([languages.index(x) for x in labels], np.int64)
        for start, part in sliced(pa.array(texts, pa.large_string())):
            words, codes, sentence, text_of, _ = sentence_words(part)
            feature, word = word_features(words, BITS, GRAMS)
            for k in range(len(languages)):
                own = np.bincount(codes[rows[start + text_of[sentence]] == k], minlength=len(words))
                counts[k] += np.bincount(feature, weights=own[word], minlength=1 << BITS)
        self.table = np.log(counts / counts.sum(axis=1, keepdims=True)).T.copy()

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for start, part in sliced(texts):
            words, codes, sentence, text_of, _ = sentence_words(part)
            feature, word = word_features(words, BITS, GRAMS)
            text = text_of[sentence]
            features = np.maximum(np.bincount(word, minlength=len(words)), 1)
            n = np.maximum(np.bincount(text, minlength=len(part)), 1)
            for k in range(len(self.languages)):
                own = np.bincount(word, weights=self.table[feature, k], minlength=len(words)) / features
                out[start : start + len(part), k] = np.bincount(text, weights=own[codes], minlength=len(part)) * (np.minimum(n, self.evidence) / n)
        out -= out.max(axis=1, keepdims=True)
        p = np.exp(out)
        return p / p.sum(axis=1, keepdims=True)


def text_model(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """A model of every language that a document has; each is counted on an even part of ``sample``, but EACH documents at least.

    ``sample`` and SAMPLE_BYTES bound only what the model is counted on; a doc_id is taken once.
    """
    known = docs.filter("lang is not null and doc_id is not null").select("doc_id", "lang", text_column().alias("text"))
    most = min(1000, max(EACH, sample // max(1, known.select("lang").distinct().count())))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id"))
    ids, counts = known.select("lang", "doc_id").distinct(), known.groupBy("lang").agg(F.count("*").alias("n"))
    # of a large language, only about four times as many as are drawn are ranked
    thin = F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(1 << 30)) * F.col("n") < F.lit(4 * most) * F.lit(float(1 << 30))
    ids = ids.join(F.broadcast(counts), "lang").filter(thin).select("lang", "doc_id").withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
    rows = known.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    rows = sample_table(rows.select("doc_id", "row.lang", "row.text"))
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    return TextModel(languages, rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, lang, score, text_lang, declared) of every row of ``pages`` (page_id, url, html).

    Null or empty html has even text evidence and no declaration; a url without host has the host "". Without
    languages in the model the result's lang is null. Ties go to the first language by name. Rows that
    repeat are kept; further columns are ignored; an empty table gives an empty result.
    """
    spark, languages = pages.sparkSession, model.languages
    small_batches(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), declared.alias("declared"), text_column("html").alias("html"))
    if not languages:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("text_lang"), "declared")
    shared = spark.sparkContext.broadcast(model)

    def read(batches):
        own = shared.value
        for batch in batches:
            html = batch.column(3)
            html = pc.replace_substring_regex(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->", " ")
            p = own.posteriors(pc.replace_substring_regex(pc.replace_substring_regex(html, r"(?s)<[^>]*>", " "), r"&[a-zA-Z0-9#]+;", " "))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(languages), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["page_id", "host", "declared", "text"])

    scored = checkpointed(rows.mapInArrow(frugal(read), "page_id long, host string, declared string, text array<double>").withColumn("suffix", F.regexp_extract("host", r"\.([a-z]+)$", 1)))
    each = range(len(languages))
    sums = [F.sum(F.col("text")[k]).alias(f"s{k}") for k in each]

    def array(make):
        return F.array(*(make(k) for k in each))

    whole = F.lit(SMOOTHING)
    everything = scored.agg(*sums, F.count("*").alias("n")).select(array(lambda k: (F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + 1) / (F.col("n") + len(languages))).alias("base"))
    suffixes = scored.groupBy("suffix").agg(*sums, F.count("*").alias("n")).crossJoin(F.broadcast(everything))
    suffixes = suffixes.select("suffix", array(lambda k: (F.col(f"s{k}") + whole * F.col("base")[k]) / (F.col("n") + whole)).alias("near"))
    hosts = scored.groupBy("host", "suffix").agg(*sums, F.count("*").alias("n")).join(suffixes, "suffix")
    hosts = hosts.select("host", array(lambda k: (F.col(f"s{k}") + whole * F.col("near")[k]) / (F.col("n") + whole)).alias("prior"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.when(F.col("declared") == "", F.lit("")).otherwise(F.lit("*")))
    said = {r["d"]: np.array([r[f"s{k}"] for k in each]) for r in scored.groupBy(known.alias("d")).agg(*sums).collect()}
    forms = [*languages, "", "*"]
    chance = np.array([said.get(f, np.zeros(len(languages))) for f in forms]) + 0.5
    chance /= chance.sum(axis=0)
    says = F.create_map(*(x for f, row in zip(forms, chance, strict=True) for x in (F.lit(f), F.array(*map(F.lit, row.tolist())))))
    fused = scored.withColumns({"salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"), "said": says[known]}).join(hosts, ["host", "salt"])
    fused = fused.withColumn("odds", array(lambda k: F.greatest(F.col("text")[k], F.lit(1e-30)) * F.col("said")[k] * F.col("prior")[k]))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    best, text_best = F.array_max("odds"), F.array_max("text")
    names = F.array(*map(F.lit, languages))
    return fused.select("page_id", names[(F.array_position("odds", best) - 1).cast("int")].alias("lang"), (best / total).alias("score"), names[(F.array_position("text", text_best) - 1).cast("int")].alias("text_lang"), "declared")


def op10_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), text_model(table(spark, sf_dir, "documents")))
