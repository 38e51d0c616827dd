"""Quality by weak labels.

Overlapping heuristics vote good, bad or nothing on every document. The counts of vote
patterns over all documents are what expectation-maximisation needs to estimate how accurate
each heuristic is; the posterior labels of a bounded sample train a linear scorer of hashed
features, which scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drawn, frugal, sample_table, sliced, small_batches, table, text_column
from ._words import word_features

BITS, GRAMS = 16, (2, 3)
#: Documents that the scorer is trained on, at most.
SAMPLE = 3000
#: Documents with at least this score are kept.
THRESHOLD = 0.5
#: Each heuristic: statistic, bad from or up to, good from or up to; between the two it abstains.
HEURISTICS = (
    ("repeats", ">", 0.25, "<", 0.08),
    ("distinct", "<", 0.12, ">", 0.25),
    ("shouting", ">", 0.4, "<", 0.1),
    ("exclaimed", ">", 0.2, "<", 0.03),
    ("symbols", ">", 0.25, "<", 0.05),
    ("wordless", ">", 0.15, "<", 0.04),
    ("length", ">", 14.0, "<", 10.0),
    ("stops", "<", 0.005, ">", 0.02),
    ("letters", "<", 0.75, ">", 0.85),
    ("endings", ">", 0.3, "<", 0.1),
)
#: Edges of the steps in which the scorer sees shares of words.
STEPS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: Shorter documents get no votes.
FEWEST_WORDS = 8


def _split(texts: pa.Array):
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    return coded.dictionary, codes[codes != empty], text[codes != empty]


def _repeats(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    return same


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """What the heuristics look at, per text, and the texts' numbers of words."""
    words, codes, text = _split(texts)
    n = np.bincount(text, minlength=len(texts))
    over = np.maximum(n, 1)

    def share(of_words: pa.Array) -> np.ndarray:
        own = of_words.to_numpy(zero_copy_only=False).astype(float)
        return np.bincount(text, weights=own[codes], minlength=len(texts)) / over

    def having(pattern: str) -> np.ndarray:
        return share(pc.match_substring_regex(words, pattern))

    def total(of_words: pa.Array) -> np.ndarray:
        return np.bincount(text, weights=of_words.to_numpy(zero_copy_only=False).astype(float)[codes], minlength=len(texts))

    pairs = np.unique(text * (len(words) + 1) + codes)
    characters = pc.utf8_length(words)
    lettered = pc.utf8_length(pc.replace_substring_regex(words, r"[^\p{L}\p{N}]+", ""))
    return {
        "repeats": np.bincount(text[_repeats(codes, text)], minlength=len(texts)) / over,
        "distinct": np.bincount(pairs // (len(words) + 1), minlength=len(texts)) / over ** np.where(n > 400, 0.85, 1.0),
        "shouting": having(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"),
        "exclaimed": having(r"!$"),
        "symbols": having(r"[#$%&*|<>{}\\^~=]"),
        "wordless": having(r"^[^\p{L}\p{N}]+$"),
        "length": share(characters),
        "letters": total(lettered) / np.maximum(total(characters), 1),
        "endings": having(r"[^\p{L}\p{N}.,;:!?)\"'\-]$"),
        "stops": having(r"[\p{L}\p{N}][.,!?;:]$"),
    }, n


def votes(texts: pa.Array) -> np.ndarray:
    """1 good, 0 bad, -1 nothing, for each text and heuristic."""
    values, n = statistics(texts)
    out = np.full((len(texts), len(HEURISTICS)), -1, np.int64)
    for k, (name, bad, bad_at, good, good_at) in enumerate(HEURISTICS):
        v = values[name]
        out[v < good_at if good == "<" else v > good_at, k] = 1
        out[v > bad_at if bad == ">" else v < bad_at, k] = 0
    out[n < FEWEST_WORDS] = -1
    return out


def _codes(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ 3 ** np.arange(v.shape[1])


def estimate(counts: dict[int, int], heuristics: int, rounds: int = 50) -> tuple[float, np.ndarray]:
    """Share of good documents and each heuristic's chance of each vote by true label, (2, heuristics, 3), from pattern counts."""
    patterns = np.array(list(counts), np.int64)
    weight = np.array(list(counts.values()), float)
    v = patterns[:, None] // 3 ** np.arange(heuristics) % 3
    bad = (v == 1).sum(axis=1)
    posterior = np.where(bad > 0, np.where(2 * bad > (v == 2).sum(axis=1), 0.05, 0.2), 0.9)
    rates = np.zeros((2, heuristics, 3))
    for _ in range(rounds):
        for label, p in ((1, posterior), (0, 1 - posterior)):
            for k in range(heuristics):
                rates[label, k] = np.bincount(v[:, k], weights=weight * p, minlength=3) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        share = float(np.clip((weight * posterior).sum() / max(weight.sum(), 1e-9), 1e-6, 1 - 1e-6))
        posterior = posteriors(v, share, rates)
    return share, rates


def posteriors(v: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    """Chance of a good document by votes (0 nothing, 1 bad, 2 good as stored)."""
    each = np.arange(v.shape[1])
    odds = np.log(share) - np.log1p(-share) + (np.log(rates[1, each, v]) - np.log(rates[0, each, v])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _steps(words: pa.Array, codes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Each text's two steps, as places behind the hashed features: of the share of repeated words, and of distinct ones."""
    n = np.bincount(text, minlength=texts)
    over = np.maximum(n, 1)
    repeats = np.bincount(text[_repeats(codes, text)], minlength=texts) / over
    pairs = np.unique(text * (len(words) + 1) + codes)
    distinct = np.bincount(pairs // (len(words) + 1), minlength=texts) / over ** np.where(n > 400, 0.85, 1.0)
    return (1 << BITS) + np.stack([np.searchsorted(STEPS, repeats), len(STEPS) + 1 + np.searchsorted(STEPS, distinct)])


def fit(texts: list[str], targets: np.ndarray, rounds: int = 120, rate: float = 0.3, penalty: float = 1e-4) -> np.ndarray:
    """Weights of the hashed features, of the steps of repeated and distinct words and the bias, by Adam on soft labels."""
    weights = np.zeros((1 << BITS) + 2 * (len(STEPS) + 1) + 1)
    if not len(texts):
        return weights
    words, codes, text = _split(pa.array(texts, pa.large_string()))
    feature, word = word_features(words, BITS, GRAMS)
    over = np.maximum(np.bincount(text, minlength=len(texts)), 1)
    steps = _steps(words, codes, text, len(texts))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    balance = np.where(targets > 0.5, 0.5 / max(targets.sum(), 1e-9), 0.5 / max((1 - targets).sum(), 1e-9))
    for t in range(1, rounds + 1):
        own = np.bincount(word, weights=weights[feature], minlength=len(words))
        z = np.bincount(text, weights=own[codes], minlength=len(texts)) / over + weights[steps].sum(axis=0) + weights[-1]
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets) * balance
        by_word = np.bincount(codes, weights=(slope / over)[text], minlength=len(words))
        grad = np.bincount(np.concatenate((feature, *steps)), weights=np.concatenate((by_word[word], slope, slope)), minlength=len(weights))
        grad[-1] = slope.sum()
        grad += penalty * weights / len(weights)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        weights = weights - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
    return weights


def vote_patterns(docs: DataFrame) -> dict[int, int]:
    """How many documents of the whole table have each pattern of votes; at most 3 ** len(HEURISTICS) of them."""

    small_batches(docs.sparkSession)

    def count(batches):
        seen = np.zeros(3 ** len(HEURISTICS), np.int64)
        for batch in batches:
            for _, part in sliced(batch.column(0)):
                seen += np.bincount(_codes(votes(part)), minlength=len(seen))
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["pattern", "n"])

    rows = docs.select(text_column()).mapInArrow(frugal(count), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in rows.collect()}


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights: vote patterns are counted over all documents; ``sample`` (and SAMPLE_BYTES) bound only what the scorer is fitted on."""
    counts = vote_patterns(docs)
    share, rates = estimate(counts, len(HEURISTICS)) if counts else (0.5, np.full((2, len(HEURISTICS), 3), 1 / 3))
    rows = drawn(docs.select("doc_id", text_column().alias("text")), "doc_id", sample, 23).groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = sample_table(rows).column("text").to_pylist()
    return fit(texts, posteriors(votes(pa.array(texts, pa.large_string())) + 1, share, rates) if texts else np.zeros(0))


def score_quality(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, score) of every row of ``docs``: the chance that its whole text is good.

    A null or empty text has no evidence but the bias. Rows that repeat are scored alike; null doc_ids
    are kept; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if weights is None else weights)

    def score(batches):
        weights = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, part in sliced(batch.column(1)):
                words, codes, text = _split(part)
                feature, word = word_features(words, BITS, GRAMS)
                own = np.bincount(word, weights=weights[feature], minlength=len(words))
                over = np.maximum(np.bincount(text, minlength=len(part)), 1)
                z = np.bincount(text, weights=own[codes], minlength=len(part)) / over + weights[_steps(words, codes, text, len(part))].sum(axis=0) + weights[-1]
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(frugal(score), "doc_id long, score double")


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).alias("keep"))
