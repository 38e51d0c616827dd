"""Words, sentences and hashed features of whole Arrow columns of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import _BYTE_VALUES, _powers_to, mixed

#: Stands between sentences.
BREAK = "\x01"
SENTENCE_END = r"[.!?\n\x{2026}\x{3002}]+"
_NOISE = r"[\x00-\x08\x0e-\x1f,;:\"()\[\]{}<>]+"


def sentence_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lower-cased words, each word's code, its sentence, each sentence's text and each text's first sentence.

    A text has one sentence more than it has runs of sentence ends; sentences may be empty.
    """
    lowered = pc.utf8_lower(pc.replace_substring_regex(texts, _NOISE, " "))
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, SENTENCE_END, f" {BREAK} "))
    counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    mark, empty = (pc.index(words, x).as_py() for x in (pa.scalar(BREAK, words.type), pa.scalar("", words.type)))
    breaks = codes == mark
    per_text = np.bincount(text[breaks], minlength=len(texts)) + 1
    firsts = np.concatenate(([0], np.cumsum(per_text)))
    sentence = np.cumsum(breaks) + text
    real = ~breaks & (codes != empty)
    return words, codes[real], sentence[real], np.repeat(np.arange(len(texts)), per_text), firsts


def word_features(words: pa.Array, bits: int, grams: tuple[int, ...] = (3, 4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs: each word as a whole and its byte n-grams, its ends marked, hashed to ``bits`` bits."""
    words = words.cast(pa.large_string())
    joined = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar("", pa.large_string()), pa.scalar("\x02", pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    powers, inverse = _powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers[:n], out=sums[1:])
    owner = np.repeat(np.arange(len(words)), np.diff(offsets))
    shift = np.uint64(64 - bits)
    features = [(mixed((sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]] + np.uint64(1)) >> shift).astype(np.int64)]
    owners = [np.arange(len(words))]
    for g in grams:
        if n < g:
            continue
        at = np.flatnonzero(owner[: n - g + 1] == owner[g - 1 :])
        features.append((mixed((sums[at + g] - sums[at]) * inverse[at] + np.uint64(g)) >> shift).astype(np.int64))
        owners.append(owner[at])
    return np.concatenate(features), np.concatenate(owners)
