"""Terms of whole Arrow columns of texts: runs of letters (or letters and digits), A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import text_slices


def _kept_bytes(digits: bool) -> np.ndarray:
    """For each byte what stands for it: itself within a term, lower-cased, or a space."""
    out = np.full(256, 0x20, np.uint8)
    out[0x80:] = np.arange(0x80, 0x100)
    out[0x61:0x7B] = out[0x41:0x5B] = np.arange(0x61, 0x7B)
    if digits:
        out[0x30:0x3A] = np.arange(0x30, 0x3A)
    return out


LETTERS, LETTERS_AND_DIGITS = _kept_bytes(False), _kept_bytes(True)


def terms(texts: pa.Array, kept: np.ndarray, most: int = 1 << 22):
    """(first row, rows, distinct terms, each term's code, each term's row) of slices of about ``most`` bytes.

    Rows count from 0 within a slice; terms come in the order of the text.
    """
    for first, data, offsets in text_slices(texts, most):
        plain = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept[data]))
        split = pc.ascii_split_whitespace(plain)
        row = np.repeat(np.arange(len(plain)), split.value_lengths().to_numpy(zero_copy_only=False))
        coded = split.flatten().dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        blank = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
        if blank >= 0:
            real = code != blank
            code, row = code[real], row[real]
        yield first, len(plain), distinct, code, row
