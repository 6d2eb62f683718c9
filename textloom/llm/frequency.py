"""Problem 1: frequency of every distinct term or n-gram.

Suffix-sorted counting: every position of a record gives the suffix that starts
there, truncated to ``sigma`` terms. Suffixes are routed by their first term,
sorted in reverse lexicographic order within a partition, and one pass with a
stack turns them into the counts of all their prefixes.

Record sets are kept as differences: within a record the suffixes are sorted, and
a suffix counts as a new record only for prefixes longer than what it shares with
its predecessor. Those numbers add up, so suffixes are combined before they move
and a term that occurs in every record costs one row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .terms import encode, pieces

RARE_RECORDS = 2
COMMON_SHARE = 0.4

_ROUTED = "suffix array<string>, shared int, n bigint"
_COUNTED = "ngram array<string>, occurrences bigint, records bigint"


def _suffixes(sigma: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch.column(0))):
            terms, codes, records = encode(piece)
            n = len(codes)
            valid = codes >= 0
            if not valid.any():
                continue
            # rows: (record, suffix); -1 behind the suffix's end
            grid = np.full((n, sigma), -1, dtype=np.int64)
            grid[:, 0] = codes
            open_ = valid.copy()
            for k in range(1, sigma):
                if n <= k:
                    break
                follows = open_[: n - k] & valid[k:] & (records[k:] == records[: n - k])
                grid[: n - k, k][follows] = codes[k:][follows]
                open_[: n - k] = follows
                open_[n - k :] = False
            grid, of = grid[valid], records[valid]
            order = np.lexsort([grid[:, k] for k in range(sigma - 1, -1, -1)] + [of])
            grid, of = grid[order], of[order]
            same = np.zeros(grid.shape, dtype=bool)
            same[1:] = (grid[1:] == grid[:-1]) & (grid[1:] >= 0) & (of[1:] == of[:-1])[:, None]
            shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            keyed = np.column_stack([grid, shared])
            order = np.lexsort([keyed[:, k] for k in range(sigma, -1, -1)])
            keyed = keyed[order]
            first = np.ones(len(keyed), dtype=bool)
            first[1:] = (keyed[1:] != keyed[:-1]).any(axis=1)
            starts = np.flatnonzero(first)
            counts = np.diff(np.append(starts, len(keyed)))
            keyed = keyed[starts]
            grid, shared = keyed[:, :sigma], keyed[:, sigma]
            sizes = (grid >= 0).sum(axis=1)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = pa.array(terms, pa.string()).take(pa.array(grid[grid >= 0]))
            # the empty suffix counts the records with any term
            root = len(np.unique(of))
            suffix = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([[]], pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays(
                [suffix, pa.array(np.append(shared, 0).astype(np.int32)), pa.array(np.append(counts, root).astype(np.int64))],
                names=["suffix", "shared", "n"],
            )

    return run


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of suffixes that come in reverse lexicographic order."""
    path: list[str] = []
    occurs: list[int] = []  # by depth, what the popped deeper prefixes left
    within: list[int] = []
    out: list[tuple[list[str], int, int]] = []

    def shrink(depth: int) -> None:
        while len(path) > depth:
            o, r = occurs.pop(), within.pop()
            out.append((list(path), o, r))
            path.pop()
            if path:
                occurs[-1] += o
                within[-1] += r

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.list_(pa.string())),
                pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2] for x in out], pa.int64()),
            ],
            names=["ngram", "occurrences", "records"],
        )
        out.clear()
        return made

    for batch in batches:
        for suffix, shared, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if not suffix:
                out.append(([], 0, n))
                continue
            if suffix != path:
                depth = 0
                for a, b in zip(path, suffix):
                    if a != b:
                        break
                    depth += 1
                shrink(depth)
                for term in suffix[depth:]:
                    path.append(term)
                    occurs.append(0)
                    within.append(0)
            occurs[-1] += n
            within[-1] += n
            if shared:
                within[shared - 1] -= n
        if len(out) > 20_000:
            yield flush()
    shrink(0)
    yield flush()


def ngram_frequencies(records: DataFrame, column: str, sigma: int = 1, salts: int = 16) -> DataFrame:
    """Occurrences and records of every n-gram of up to ``sigma`` terms.

    ``records`` has one row a record and its elements in the array ``column``; other
    columns are ignored. Elements that are no terms are left out and end an n-gram.
    Returns ``(ngram array<string>, occurrences, records)``; the empty n-gram's
    ``records`` is the number of records with at least one term (no row where there
    is none). Null arrays and empty ones count as records without terms.

    Suffixes of two or more terms are also routed by a hash of their second term
    (``salts`` ways), so a frequent first term does not fill one task; the parts are
    summed at the end.
    """
    routed = records.select(F.col(column).cast("array<string>").alias("suffix")).mapInArrow(_suffixes(sigma), _ROUTED)
    if sigma > 1:
        salt = F.when(F.size("suffix") > 1, F.pmod(F.xxhash64(F.try_element_at("suffix", F.lit(2))), F.lit(salts))).otherwise(F.lit(0))
        spread = routed.repartition(F.try_element_at("suffix", F.lit(1)), salt)
    else:
        spread = routed.repartition(F.try_element_at("suffix", F.lit(1)))
    counted = spread.sortWithinPartitions(F.col("suffix").desc()).mapInArrow(_stack, _COUNTED)
    return counted.groupBy("ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_marks(
    records: DataFrame,
    column: str,
    sigma: int = 1,
    rare_records: int = RARE_RECORDS,
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """Counts of every n-gram with its mark.

    ``mark`` is ``rare`` for n-grams in at most ``rare_records`` records, ``common``
    for those in more than ``common_share`` of the records that have a term, else
    null; where both hold (few records at all), ``rare`` wins. Returns
    ``(term, n_terms, occurrences, records, mark)``, ``term`` joined by blanks.
    """
    counts = cut_lineage(ngram_frequencies(records, column, sigma))
    root = counts.where(F.size("ngram") == 0).select("records").first()
    total = root[0] if root else 0
    return counts.where(F.size("ngram") > 0).select(
        F.array_join("ngram", " ").alias("term"),
        F.size("ngram").alias("n_terms"),
        "occurrences",
        "records",
        F.when(F.col("records") <= rare_records, F.lit("rare"))
        .when(F.col("records") > common_share * total, F.lit("common"))
        .alias("mark"),
    )
