"""Token ids of a word-level BPE vocabulary, many distinct words at a time.

Texts are cut at ASCII white space, each distinct piece is encoded once, and all new words of
one byte length go through the merges together as one matrix. Pieces outside plain Latin
text, special tokens and very long words are left to the tokenizer itself, so the ids are
those that it gives for the whole text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RARE = r"[^!-~À-ÖØ-öø-ÿ]|<\|"
_PRETOKENS = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"
_ABSENT = 1 << 30
#: Longer words, in bytes, go to the tokenizer itself.
_LONGEST = 40


def _byte_characters() -> list[str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, k = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + k))
        k += b not in own
    return out


class WordEncoder:
    def __init__(self, path: str, cache: int = 200_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.path, self.tokenizer, self.most = path, None, cache
        self._clear()
        self.inner = np.array([vocab[c] for c in _byte_characters()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in _byte_characters()], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.merged = merged
        ranks = np.arange(len(keys), dtype=np.int64)
        self.levels = []
        while len(keys):
            table, rank = np.full(1 << 18, -1, np.int64), np.full(1 << 18, _ABSENT, np.int64)
            place = self._place(keys, len(self.levels))
            table[place[::-1]], rank[place[::-1]] = keys[::-1], ranks[::-1]
            missed = table[place] != keys
            self.levels.append((table, rank))
            keys, ranks = keys[missed], ranks[missed]

    def _clear(self) -> None:
        # the empty string has no ids
        self.names, self.flat = pa.array([""], pa.large_string()), np.zeros(0, np.uint32)
        self.firsts, self.counts = np.zeros(1, np.int64), np.zeros(1, np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)) >> np.uint64(46)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        out = None
        for level, (table, rank) in enumerate(self.levels):
            place = self._place(keys, level)
            found = np.where(table[place] == keys, rank[place], _ABSENT)
            out = found if out is None else np.minimum(out, found)
        return out

    def _exactly(self, text: str) -> np.ndarray:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens, one after the other, and how many each has; all of one byte length are merged as a matrix."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        done_rows: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(sizes, kind="stable")
        lengths, begins = np.unique(sizes[order], return_index=True)
        for length, rows in zip(lengths.tolist(), np.split(order, begins[1:]), strict=False):
            if length > _LONGEST:
                done_rows += [(np.array([r]), self._exactly(words[r].as_py())[None]) for r in rows.tolist()]
                continue
            data = _bytes(words.take(pa.array(rows))).reshape(-1, length)
            ids = self.inner[data]
            ids[:, -1] = self.last[data[:, -1]]
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            while len(ids) and ids.shape[1] > 1:
                every = np.arange(len(ids))
                at = ranks.argmin(axis=1)
                best = ranks[every, at]
                done = best == _ABSENT
                if done.any():
                    done_rows.append((rows[done], ids[done]))
                    ids, rows, ranks, at, best = (x[~done] for x in (ids, rows, ranks, at, best))
                    every = np.arange(len(ids))
                    if not len(ids):
                        break
                ids[every, at] = self.merged[best]
                keep = np.ones(ids.shape, bool)
                keep[every, at + 1] = False
                ids = ids[keep].reshape(len(ids), -1)
                # only the pairs beside the merged one change
                ranks = ranks[keep[:, 1:]].reshape(len(ids), -1)
                for side in (at - 1, at):
                    has = np.flatnonzero((side >= 0) & (side < ids.shape[1] - 1))
                    left = side[has]
                    ranks[has, left] = self._ranks(ids[has, left], ids[has, left + 1])
            if len(ids):
                done_rows.append((rows, ids))
        counts = np.zeros(len(words), np.int64)
        for rows, ids in done_rows:
            counts[rows] = ids.shape[1]
        firsts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.uint32)
        for rows, ids in done_rows:
            flat[firsts[rows, None] + np.arange(ids.shape[1])] = ids
        return flat, counts

    def _pretokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First place among the kept ids, and number of ids, of distinct pretokens; new ones are merged and kept."""
        if len(self.names) > self.most:
            self._clear()
        place = pc.index_in(words, value_set=self.names)
        missing = words.filter(place.is_null())
        if len(missing):
            flat, counts = self._merged(missing)
            known = len(self.names)
            self.names = pa.concat_arrays([self.names, missing])
            self.firsts = np.concatenate((self.firsts, len(self.flat) + np.cumsum(counts) - counts))
            self.counts, self.flat = np.concatenate((self.counts, counts)), np.concatenate((self.flat, flat))
            own = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            own[own < 0] = known + np.arange(len(missing))
        else:
            own = place.to_numpy(zero_copy_only=False).astype(np.int64)
        return self.firsts[own], self.counts[own]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids that hold those of distinct white-space-free pieces of text, each one's first and its number of ids."""
        rare = pc.match_substring_regex(pieces, _RARE).to_numpy(zero_copy_only=False)
        own = [self._exactly(x) for x in pieces.filter(pa.array(rare)).to_pylist()]
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pieces.filter(pa.array(~rare))), _PRETOKENS, r"\1 "))
        coded = split.flatten().dictionary_encode()
        firsts, counts = self._pretokens(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat, counts = _gathered(self.flat, firsts[codes], counts[codes])
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))))]
        sizes, places = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        sizes[~rare], places[~rare] = np.diff(ends), ends[:-1]
        sizes[rare] = [len(x) for x in own]
        places[rare] = len(flat) + np.cumsum(sizes[rare]) - sizes[rare]
        return np.concatenate([flat, *own]), places, sizes

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and each text's offset among them; ``end`` follows each text's ids."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        flat, firsts, sizes = self._pieces(coded.dictionary)
        if end is not None:
            flat, firsts, sizes = np.append(flat, np.uint32(end)), np.append(firsts, len(flat)), np.append(sizes, 1)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        words = np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        if end is not None:
            codes = np.insert(codes, words[1:], len(sizes) - 1)
            words = words + np.arange(len(words))
        taken, lengths = _gathered(flat, firsts[codes], sizes[codes])
        return taken, np.concatenate(([0], np.cumsum(lengths)))[words]


def _bytes(words: pa.Array) -> np.ndarray:
    """All bytes of an array of strings."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def _gathered(flat: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that begin at ``firsts``, one after the other, and their lengths."""
    ends = np.cumsum(counts)
    return flat[np.repeat(firsts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts
