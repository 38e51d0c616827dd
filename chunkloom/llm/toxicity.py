"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in hashed features of its
words; a document is toxic unless all of its sentences are clean and nothing leaks (leaky noisy-or), and only
documents have labels. Sentences without a telling feature, or with a score that is less than NOTHING, are clean for certain and add nothing, so a
score does not grow with the length of a clean text. The trained sentence scores locate the offending sentences.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frugal, least_hashed, sample_table, sliced, small_batches, table, text_column
from ._words import SENTENCE_END, sentence_words, word_features

#: Hash bits of the features.
BITS = 18
#: Labelled documents that a model is fitted on, at most; drawn by a seeded hash of doc_id.
SAMPLE = 10_000
#: Bytes of text that are scored at once, about.
SLICE = 1 << 19
#: Sentences that score less are clean; of the others the excess counts.
NOTHING = 0.02
#: The log-odds of a telling sentence before its features, if nothing is known.
PRIOR = -6.0
#: Documents with at least this score are toxic.
THRESHOLD = 0.3
_ENDS = re.compile(SENTENCE_END.replace(r"\x{2026}\x{3002}", "…。"))


def _slices(texts: pa.Array):
    for row, part in sliced(texts, SLICE):
        yield row, sentence_words(part)


def _telling(texts: pa.Array, labels: np.ndarray, most: int, least: int, sigmas: float, lift: float) -> np.ndarray:
    """Features whose share in toxic documents is larger than chance allows and ``lift`` times that in clean ones, the strongest ``most``."""
    seen = np.zeros((2, 1 << BITS))
    for row, (words, codes, sentence, text_of, _) in _slices(texts):
        pairs = np.unique(text_of[sentence] * len(words) + codes)
        feature, word = word_features(words, BITS)
        for y in (0, 1):
            own = pairs[labels[row + pairs // len(words)] == y] % len(words)
            seen[y] += np.bincount(feature, weights=np.bincount(own, minlength=len(words))[word], minlength=1 << BITS)
    rate, total = seen[1].sum() / seen.sum(), seen.sum(axis=0)
    strength = (seen[1] - rate * total) / np.sqrt(np.maximum(total, 1) * rate * (1 - rate))
    strength[(total < least) | (strength < sigmas) | (seen[1] * seen[0].sum() < lift * seen[0] * seen[1].sum())] = 0
    best = np.argsort(-strength, kind="stable")[:most]
    return np.sort(best[strength[best] > 0])


#: Weights of the features, the log-odds of a telling sentence before its features, and those of a document without any.
Model = tuple[np.ndarray, float, float]


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 150, rate: float = 0.15, penalty: float = 0.02, features: int = 2048, least: int = 4, sigmas: float = 4.5, lift: float = 2.5, held: float = 0.01) -> Model:
    """Feature weights, a telling sentence's bias and the leak, by Adam on the likelihood of the documents' labels.

    Only the ``features`` that tell most between the labels, by ``sigmas`` and ``lift`` at least, are weighted. The bias is ``held`` near PRIOR,
    so that one feature, as a word may have by chance, is no proof. Without texts of both labels the score is constant.
    """
    weights = np.zeros(1 << BITS, np.float32)
    if not len(texts) or labels.min() == labels.max():
        return weights, -12.0, (3.0 if len(texts) and labels.min() else -12.0)
    used = _telling(texts, labels, features, least, sigmas, lift)
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    rows, columns, owners, bags = [], [], [], 0
    for at, (words, codes, sentence, text_of, _) in _slices(texts):
        feature, word = word_features(words, BITS)
        keep = place[feature] >= 0
        feature, word = place[feature[keep]], word[keep]
        order = np.argsort(word, kind="stable")
        feature, counts = feature[order], np.bincount(word, minlength=len(words))
        begin = np.cumsum(counts) - counts
        each = counts[codes]
        own = np.repeat(begin[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        telling, row = np.unique(np.repeat(sentence, each), return_inverse=True)
        rows.append(row + bags)
        columns.append(feature[own])
        owners.append(text_of[telling] + at)
        bags += len(telling)
    row, column, text_of = (np.concatenate(x) for x in (rows, columns, owners))
    w = np.zeros(len(used) + 2)
    w[-2:] = PRIOR, -4.0
    first, second = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[column], minlength=bags) + w[-2]
        p, leak = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-np.clip(w[-1], -30, 30)))
        counts = p > NOTHING
        clean = np.bincount(text_of, weights=np.where(counts, -np.logaddexp(0, z) - np.log1p(-NOTHING), 0), minlength=len(texts)) - np.logaddexp(0, w[-1])
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        of_text = np.where(labels == 1, -np.exp(clean) / toxic, 1.0) / len(texts)
        slope = of_text[text_of] * p * (counts | (labels[text_of] == 1))  # what does not count yet can come to count in toxic texts
        grad = np.concatenate((np.bincount(column, weights=slope[row], minlength=len(used)) + penalty / len(texts) * w[:-2], [slope.sum() + held * (w[-2] - PRIOR), of_text.sum() * leak]))
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    weights[used] = w[:-2]
    return weights, float(w[-2]), float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, seed: int = 11) -> DataFrame:
    """At most ``sample`` labelled documents (text, label); doc_ids whose crc32 is 2 modulo 4 are held out."""
    known = labels.filter(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    known = least_hashed(known.filter(~held_out("doc_id")), sample, seed, "doc_id")
    rows = docs.select("doc_id", text_column().alias("text")).join(F.broadcast(known), "doc_id")
    # of rows that repeat a doc_id, the one with the least text
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__label").alias("__label"))


def held_out(name: str):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents, of SAMPLE_BYTES at most, that are not held out; labels are used for nothing else."""
    rows = sample_table(training_rows(docs, labels, "toxic", sample))
    return fit(rows.column("text").cast(pa.large_string()).combine_chunks(), rows.column("__label").to_numpy())


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, sentences) of every row: noisy-or over all sentences of the whole text, and those at fault.

    ``sentences`` holds (start, end, score) in code points of the sentences that reach ``threshold`` alone,
    or of the worst one where only all together do; it is empty below the threshold, and where no sentence tells. A null or empty text
    is one empty sentence. Rows that repeat are scored alike; a null doc_id is kept.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def score(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(1)
            scores, spans = [], []
            for row, part in sliced(texts, SLICE):
                toxic, p, firsts = _scores(part, model)
                scores.append(toxic)
                for k, bad in enumerate(toxic >= threshold):
                    spans.append(_offending(texts[row + k].as_py(), p[firsts[k] : firsts[k + 1]], threshold) if bad else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, pa.list_(span))], ["doc_id", "score", "sentences"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return rows.mapInArrow(frugal(score), "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text scores below ``threshold``; a null text is an empty one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        model = shared.value
        for batch in batches:
            scores = [_scores(part, model)[0] for _, part in sliced(batch.column(at), SLICE)]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold) if scores else pa.array([], pa.bool_()))

    return docs.mapInArrow(frugal(keep), docs.schema)


def _scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' scores, sentences' scores and each document's first sentence."""
    weights, bias, leak = model
    words, codes, sentence, text_of, firsts = sentence_words(texts)
    feature, word = word_features(words, BITS)
    own, tells = (np.bincount(word, weights=x, minlength=len(words))[codes] for x in (weights[feature], weights[feature] != 0))
    z = np.bincount(sentence, weights=own, minlength=len(text_of)) + bias
    p = np.where(np.bincount(sentence, weights=tells, minlength=len(text_of)) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
    p = np.maximum(0, (p - NOTHING) / (1 - NOTHING))
    clean = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-13)), firsts[:-1]) - np.logaddexp(0, leak)
    return -np.expm1(clean), p, firsts


def _offending(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    bad = np.flatnonzero(p >= min(threshold, p.max())) if p.max() > 0 else np.zeros(0, int)
    ends = [(m.start(), m.end()) for m in _ENDS.finditer(text)]
    starts, stops = [0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)]
    return [{"start": starts[k], "end": stops[k], "score": float(p[k])} for k in bad.tolist()]


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"))
