"""Helpers for work on Arrow batches of texts inside tasks: small slices and word tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
"""Text bytes that are worked on at once; a longer text is a slice of its own."""


class Words(NamedTuple):
    """The words of some texts: for each word the text it is in and its place in ``distinct``."""

    text: np.ndarray
    code: np.ndarray
    distinct: pa.Array


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``SLICE_BYTES`` of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(group)]):
        # Copied: on slices that share buffers some Arrow string functions returned other bytes than the text's.
        yield batch.take(pa.array(np.arange(start, end)))


def _table(lists: pa.Array) -> Words:
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(lists)), counts)
    code = coded.indices.to_numpy(zero_copy_only=False)
    filled = np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) == 0)
    if len(filled):
        keep = ~np.isin(code, filled)
        text, code = text[keep], code[keep]
    return Words(text, code, coded.dictionary)


def ascii_words(texts: pa.Array, lower: bool = True) -> Words:
    """Runs of characters other than ASCII white space, A-Z in lower case; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return _table(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))


def letter_words(texts: pa.Array) -> Words:
    """Runs of Unicode letters in lower case; a null text has none."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return _table(pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"[^\p{L}]+", " ")))
