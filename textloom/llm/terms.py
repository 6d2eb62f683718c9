"""Terms of token arrays: normalised, and encoded batch by batch.

A term is an array element in composed Unicode form (NFC), trimmed and
lower-cased, that has at least one letter. Null, empty and wordless elements are
no terms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def normal_term(raw: str | None) -> str | None:
    """The term that a raw element stands for, or None."""
    if raw is None:
        return None
    text = raw if raw.isascii() else unicodedata.normalize("NFC", raw)
    text = text.strip().lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text if any(map(str.isalpha, text)) else None


#: Elements that are worked on at once, unless one record has more.
PIECE_ELEMENTS = 4_000_000


def pieces(column: pa.Array, most: int = PIECE_ELEMENTS) -> Iterator[pa.Array]:
    """Slices of a list column, of whole records and about ``most`` elements at most."""
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=float))
    group = (np.cumsum(lengths) // most).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(column)]])
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            yield column.slice(int(lo), int(hi - lo))


def encode(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct terms of a list column, and for each element its term's number
    (-1: none) and its record's number. Each distinct spelling is normalised once.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    values = column.flatten()
    lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    records = np.repeat(np.arange(len(column)), lengths)
    coded = values.dictionary_encode()
    spelled = coded.dictionary.to_pylist()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers: dict[str, int] = {}
    terms: list[str] = []
    mapped = np.full(len(spelled) + 1, -1, dtype=np.int64)
    for k, raw in enumerate(spelled):
        term = normal_term(raw)
        if term is not None:
            if term not in numbers:
                numbers[term] = len(terms)
                terms.append(term)
            mapped[k] = numbers[term]
    return terms, mapped[codes], records
