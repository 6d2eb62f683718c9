"""Problem 7: items that occur together, by a blocked Gram matrix.

Records are rows of a binary record-by-item matrix X; the pair counts are the upper
half of X'X. Every block of records is multiplied on its own (dense item blocks
where they are well filled, else by expanding the sparse rows) and the partial
counts are summed.

Pairs that cannot pass are never built, and no pair that can pass is lost: with
``n_ab <= min(n_a, n_b)`` a pair can have ``n_ab >= s`` only if both items occur in
``s`` records, and a lift of at least ``l`` only if both occur in at most ``N / l``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frequency import ngram_frequencies
from ..session import cut_lineage, numbered
from .terms import encode, pieces

MIN_TOGETHER = 5
MIN_SHARE = 0.001
MIN_LIFT = 12.0
#: Items whose dictionary may be sent to every task; beyond it items are encoded by a join.
DICTIONARY_ITEMS = 400_000
DENSE_ITEMS = 1024
RECORD_BLOCK = 4096
PAIR_BLOCK = 4_000_000


def _sparse(items: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper half of X'X of sorted sparse rows, expanded in bounded pieces."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    position = np.arange(len(items)) - np.repeat(starts, sizes)
    later = np.repeat(sizes, sizes) - position - 1
    total = np.cumsum(later)
    lo = 0
    while lo < len(items):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + PAIR_BLOCK, "right")))
        count = later[lo:hi]
        left = np.repeat(np.arange(lo, hi), count)
        step = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + 1
        code = items[left].astype(np.int64) << 32 | items[left + step]
        kept.append(np.unique(code, return_counts=True))
        lo = hi
    if not kept:
        return (np.empty(0, np.int64),) * 3
    codes, at = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([k[1] for k in kept])).astype(np.int64)
    return codes >> 32, codes & 0xFFFFFFFF, n


def _dense(items: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper half of X'X by products of dense item blocks."""
    parts = []
    height = int(rows.max()) + 1 if len(rows) else 0
    blocks = []
    for lo in range(0, width, DENSE_ITEMS):
        inside = (items >= lo) & (items < lo + DENSE_ITEMS)
        block = np.zeros((height, min(DENSE_ITEMS, width - lo)), dtype=np.float32)
        block[rows[inside], items[inside] - lo] = 1
        blocks.append((lo, block))
    for k, (lo_a, a) in enumerate(blocks):
        for lo_b, b in blocks[k:]:
            product = a.T @ b
            if lo_a == lo_b:
                product = np.triu(product, 1)
            i, j = np.nonzero(product)
            parts.append((i + lo_a, j + lo_b, product[i, j].astype(np.int64)))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3


def _gram(record: np.ndarray, item: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pair counts of (record, item) incidences, block of records by block."""
    if not len(item):
        return
    cells = np.unique(record.astype(np.int64) * width + item)
    record, item = cells // width, cells % width
    _, record = np.unique(record, return_inverse=True)
    for lo in range(0, int(record.max()) + 1, RECORD_BLOCK):
        inside = slice(*np.searchsorted(record, [lo, lo + RECORD_BLOCK]))
        rows, items = record[inside] - lo, item[inside]
        sizes = np.bincount(rows)
        pairs = int((sizes.astype(np.int64) * (sizes - 1) // 2).sum())
        if width <= 4 * DENSE_ITEMS and pairs * 40 > len(sizes) * width * width // 16:
            yield _dense(items, rows, width)
        else:
            yield _sparse(items, np.cumsum(sizes) - sizes, sizes)


def _gram_batches(numbers: dict[str, int] | None, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in (p for batch in batches for p in pieces(batch.column(0))):
            if numbers is None:
                records = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
                items = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                terms, codes, records = encode(column)
                mapped = np.array([numbers.get(t, -1) for t in terms] + [-1], dtype=np.int64)
                items = mapped[codes]
                records, items = records[items >= 0], items[items >= 0]
            for a, b, n in _gram(records, items, width):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return run


def frequent_pairs(
    records: DataFrame,
    column: str,
    min_together: int = MIN_TOGETHER,
    min_share: float = MIN_SHARE,
    min_lift: float = MIN_LIFT,
    dictionary_items: int = DICTIONARY_ITEMS,
) -> DataFrame:
    """Pairs of terms with their joint records and their ratio to chance.

    ``records`` has one row a record, its elements in the array ``column``. A term
    counts once a record; null arrays and records without terms are not counted in N.
    Returns ``(term_a, term_b, n_a, n_b, n_ab, lift)`` with ``term_a < term_b`` by
    code point, for pairs with ``n_ab >= min_together``, ``n_ab >= min_share * N`` and
    ``n_ab * N >= min_lift * n_a * n_b``. An empty table gives no rows.
    """
    spark = records.sparkSession
    counts = cut_lineage(ngram_frequencies(records, column).select(F.try_element_at("ngram", F.lit(1)).alias("term"), F.col("records").alias("n")))
    root = counts.where(F.col("term").isNull()).select("n").first()
    total = root[0] if root else 0
    least = max(min_together, math.ceil(min_share * total - 1e-9), 1)
    vocabulary = counts.where(F.col("term").isNotNull() & (F.col("n") >= least) & (F.col("n") * min_lift <= total))
    # A record has only so many terms, so with a share the vocabulary is bounded by
    # (mean terms a record) / min_share whatever the number of records; checked here.
    size = vocabulary.count()
    if size <= dictionary_items:
        # Python orders strings by code point, so numbers keep the order of terms
        words = sorted((row.term, row.n) for row in vocabulary.collect())
        numbers = {word: k for k, (word, _) in enumerate(words)}
        names = spark.createDataFrame([(k, word, n) for k, (word, n) in enumerate(words)], "item long, term string, n long")
        names = F.broadcast(names)
        pairs = records.select(F.col(column).cast("array<string>").alias("x")).mapInArrow(_gram_batches(numbers, max(1, size)), "a long, b long, n long")
    else:
        names = cut_lineage(numbered(vocabulary.select("term", "n"), "item", "term").select("item", "term", "n"))
        baskets = _encoded_by_join(records, column, names)
        pairs = baskets.mapInArrow(_gram_batches(None, size), "a long, b long, n long")
    summed = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_ab"))
    summed = summed.where(F.col("n_ab") >= least)
    left = names.select(F.col("item").alias("a"), F.col("term").alias("term_a"), F.col("n").alias("n_a"))
    right = names.select(F.col("item").alias("b"), F.col("term").alias("term_b"), F.col("n").alias("n_b"))
    expected = F.col("n_a").cast("double") * F.col("n_b") / F.lit(float(max(total, 1)))
    return (
        summed.join(left, "a")
        .join(right, "b")
        .where(F.col("n_ab").cast("double") * F.lit(float(total)) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
        .select("term_a", "term_b", "n_a", "n_b", "n_ab", (F.col("n_ab") / expected).alias("lift"))
    )


def _normal_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, codes, records = encode(batch.column(1))
        keep = codes >= 0
        if keep.any():
            cells = np.unique(records[keep] * len(terms) + codes[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cells // len(terms))), pa.array(terms, pa.string()).take(pa.array(cells % len(terms)))],
                names=["record", "term"],
            )


def _encoded_by_join(records: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Sorted item numbers of each record, for vocabularies too large to send around."""
    # numbers of rows of a written table stay the same when a task is repeated
    written = cut_lineage(records.select(F.col(column).cast("array<string>").alias("x")))
    keyed = written.select(F.monotonically_increasing_id().alias("record"), "x")
    incidences = keyed.mapInArrow(_normal_terms, "record long, term string")
    return incidences.join(names, "term").groupBy("record").agg(F.collect_list("item").alias("items")).select("items")
