"""Exploration of urls and of the crawl: path parts, endings, byte pairs, patterns, history."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard

#: Strings of together so many characters are merged in one task, more of them in rounds of Spark.
TASK_CHARS = 2_000_000
#: Pairs that a round chooses at first, and at most.
FIRST_PAIRS, MOST_PAIRS = 64, 4096


def path_part_counts(df: DataFrame, url: str) -> DataFrame:
    """``(part, n)`` of the parts of urls between slashes, the last part of each left out."""
    parts = F.split(url, "/")
    return df.where(F.col(url).isNotNull()).select(F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def url_endings(df: DataFrame, url: str) -> DataFrame:
    """Distinct last parts; of urls that end in a slash the part before it."""
    parts = F.split(url, "/")
    end = F.when(F.col(url).endswith("/"), F.try_element_at(parts, F.lit(-2))).otherwise(F.try_element_at(parts, F.lit(-1)))
    return df.where(F.col(url).isNotNull()).select(end.alias("ending")).distinct()


def _merge_words(words: list[list[str]], times: list[int], iterations: int, least: int) -> list[tuple[str, str, int]]:
    """Merges of pairs found ``least`` times, made in the words; only words with the merged pair are counted anew."""
    counts: Counter = Counter()
    holders: dict[tuple[str, str], set[int]] = defaultdict(set)
    for w, symbols in enumerate(words):
        for pair in zip(symbols, symbols[1:]):
            counts[pair] += times[w]
            holders[pair].add(w)
    heap = [(-k, *pair) for pair, k in counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str, int]] = []
    while heap and len(merges) < iterations:
        k, a, b = heapq.heappop(heap)
        if counts[a, b] != -k or not k:
            continue
        if -k < least:
            break
        merges.append((a, b, -k))
        changed: set[tuple[str, str]] = set()
        for w in holders.pop((a, b)):
            old, new, at = words[w], [], 0
            while at < len(old):
                joins = old[at] == a and at + 1 < len(old) and old[at + 1] == b
                new.append(a + b if joins else old[at])
                at += 1 + joins
            for pair in zip(old, old[1:]):
                counts[pair] -= times[w]
                holders[pair].discard(w)
                changed.add(pair)
            for pair in zip(new, new[1:]):
                counts[pair] += times[w]
                holders[pair].add(w)
                changed.add(pair)
            words[w] = new
        for pair in changed:
            if counts[pair]:
                heapq.heappush(heap, (-counts[pair], *pair))
    return merges


def _merges(iterations: int):
    """All rounds over the rows ``(symbols, n)`` of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[list[str]] = []
        times: list[int] = []
        for batch in batches:
            words += batch.column(0).to_pylist()
            times += batch.column(1).to_pylist()
        merges = _merge_words(words, times, iterations, 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words + [[a, b] for a, b, _ in merges], pa.list_(pa.string())),
                pa.array(times + [k for _, _, k in merges], pa.int64()),
                pa.array([-1] * len(words) + list(range(len(merges))), pa.int32()),
            ],
            names=["symbols", "n", "number"],
        )

    return run


# Symbols of many strings are numbers, a string is the bytes of its int32: a character is its code point,
# the k-th string that merges made is _FIRST + k. In a flat array each string is followed by _END.

_FIRST = 0x110000
_END = -1


def _name(symbol: int, made: list[str]) -> str:
    return made[symbol - _FIRST] if symbol >= _FIRST else chr(symbol)


def _flat(column: pa.Array) -> np.ndarray:
    strings = column.to_pylist()
    return np.insert(np.frombuffer(b"".join(strings), np.int32), np.cumsum([len(s) // 4 for s in strings], dtype=np.int64), _END)


def _strings(flat: np.ndarray) -> pa.Array:
    ends = np.flatnonzero(flat == _END)
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = 4 * (ends - np.arange(len(ends)))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat[flat != _END].tobytes())])


def _pair_keys(flat: np.ndarray) -> np.ndarray:
    """A number for each symbol with the next one, negative at the end of a string."""
    keys = (flat[:-1].astype(np.int64) << 32) | flat[1:]
    keys[(flat[:-1] == _END) | (flat[1:] == _END)] = -1
    return keys


def _summed(keys: pa.Array, n: np.ndarray, names: list[str]) -> pa.RecordBatch:
    found = pa.table([keys, pa.array(n, pa.int64())], names=["k", "n"]).group_by("k", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    return pa.RecordBatch.from_arrays([found["k"].combine_chunks(), found["n_sum"].combine_chunks()], names=names)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([s.encode("utf-32-le") for s in batch.column(0).to_pylist()], pa.binary()), batch.column(1)], names=["symbols", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = _flat(batch.column(0))
        keys = _pair_keys(flat)
        n = np.repeat(batch.column(1).to_numpy(), np.diff(np.flatnonzero(flat == _END), prepend=-1))[: len(keys)]
        yield _summed(pa.array(keys[keys >= 0]), n[keys >= 0], ["pair", "n"])


def _pieces(pairs: list[int]):
    """Strings cut between symbols that are no pair of ``pairs``; single symbols are left out."""
    chosen = np.array(sorted(pairs), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = _flat(batch.column(0))
            n = np.repeat(batch.column(1).to_numpy(), np.diff(np.flatnonzero(flat == _END), prepend=-1))
            keys = _pair_keys(flat)
            joined = chosen[np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)] == keys
            after, before = np.append(joined, False), np.insert(joined, 0, False)
            kept = after | before
            last = (before & ~after)[kept]
            yield _summed(_strings(np.insert(flat[kept], np.flatnonzero(last) + 1, _END)), n[kept][last], ["symbols", "n"])

    return run


def _found_merges(iterations: int, least: int, made: list[str]):
    """Merges of the pieces of one task, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[list[str]] = []
        times: list[int] = []
        for batch in batches:
            words += [[_name(x, made) for x in np.frombuffer(s, np.int32).tolist()] for s in batch.column(0).to_pylist()]
            times += batch.column(1).to_pylist()
        merges = _merge_words(words, times, iterations, least)
        yield pa.RecordBatch.from_pylist([{"number": i, "a": a, "b": b, "n": k} for i, (a, b, k) in enumerate(merges)], pa.schema([("number", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))

    return run


def _applied(merges: list[tuple[int, int, int]]):
    """Each ``a`` before a ``b`` replaced, from left to right, by the symbol of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = _flat(batch.column(0))
            for a, b, both in merges:
                at = np.flatnonzero(flat[:-1] == a)
                at = at[flat[at + 1] == b]
                if a == b and len(at):
                    # of a run of the symbol every second place
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, place, 0))) % 2 == 0]
                if len(at):
                    flat[at] = both
                    flat = np.delete(flat, at + 1)
            yield pa.RecordBatch.from_arrays([_strings(flat), batch.column(1)], names=["symbols", "n"])

    return run


def _named(made: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = [[_name(x, made) for x in np.frombuffer(s, np.int32).tolist()] for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(strings, pa.list_(pa.string())), batch.column(1)], names=["symbols", "n"])

    return run


def _pair_names(made: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([_name(k >> 32, made) for k in keys], pa.string()), pa.array([_name(k & 0xFFFFFFFF, made) for k in keys], pa.string())], names=["a", "b"])

    return run


def _next_merges(state: DataFrame, left: int, made: list[str], task_chars: int, width: int) -> tuple[list[tuple[str, str, int]], int]:
    """The next merges of all strings, one at least if there is a pair, and how many pairs to choose next time.

    The most frequent pairs are chosen, all that are found ``least`` times. Merges do not cross
    the ends of what becomes one symbol, so equal symbols are made alike; wherever two meet,
    their last and first part met before, at least as often. So pairs found ``least`` times lie
    within pieces of the strings that have chosen pairs only, and the distinct pieces, which are
    few, tell these merges in order.
    """
    counts = cut_lineage(state.mapInArrow(_counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    grows = True
    while True:
        top = counts.orderBy(F.col("n").desc()).limit(width + 1).collect()
        if not top:
            return [], width
        least = top[width].n + 1 if len(top) > width else 1
        chosen = [r.pair for r in top if r.n >= least]
        if not chosen and grows and width < MOST_PAIRS:
            width *= 2  # all of them are as frequent
            continue
        if not chosen:
            break
        pieces = cut_lineage(state.mapInArrow(_pieces(chosen), "symbols binary, n bigint").groupBy("symbols").agg(F.sum("n").alias("n")))
        chars = pieces.agg(F.sum(F.length("symbols") / 4)).first()[0]
        merges = []
        if chars <= task_chars:
            found = pieces.coalesce(1).mapInArrow(_found_merges(left, least, made), "number int, a string, b string, n bigint")
            merges = [(r.a, r.b, r.n) for r in sorted(found.collect(), key=lambda r: r.number)]
        discard(pieces)
        if merges:
            discard(counts)
            return merges, min(2 * width, MOST_PAIRS) if 8 * chars <= task_chars else width
        if len(chosen) == 1:
            break
        width, grows = len(chosen) // 2, False
    best = counts.where(F.col("n") == top[0].n).mapInArrow(_pair_names(made), "a string, b string").agg(F.min(F.struct("a", "b")).alias("p")).first().p
    discard(counts)
    return [(best.a, best.b, top[0].n)], width


def byte_pairs(words: DataFrame, column: str, iterations: int, task_chars: int = TASK_CHARS) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """Byte-pair merges of the strings of a column: ``(symbols, n)`` and the merges in order.

    Equal strings are merged once with their number. Each merge takes the most frequent
    adjacent pair (ties: the lesser pair by code point) and joins it from left to right
    without overlap. Ends early when no pair is left. Strings of up to ``task_chars``
    characters together are merged in one task; of more of them one task finds many merges
    at once from distinct pieces of the strings, up to ``task_chars`` characters, and all
    tasks make them; only merges and their most frequent pairs reach the driver.
    """
    distinct = cut_lineage(words.where(F.length(column) > 0).groupBy(F.col(column).alias("s")).agg(F.count("*").alias("n")))
    if (distinct.agg(F.sum(F.length("s"))).first()[0] or 0) <= task_chars:
        state = distinct.select(F.filter(F.split("s", ""), lambda c: c != "").alias("symbols"), "n")
        done = cut_lineage(state.coalesce(1).mapInArrow(_merges(iterations), "symbols array<string>, n bigint, number int"))
        discard(distinct)
        found = [(*r.symbols, r.n) for r in done.where("number >= 0").orderBy("number").collect()]
        return done.where("number < 0").select("symbols", "n"), found
    state = cut_lineage(distinct.mapInArrow(_encoded, "symbols binary, n bigint"))
    discard(distinct)
    merges: list[tuple[str, str, int]] = []
    numbers: dict[str, int] = {}
    width = FIRST_PAIRS
    while len(merges) < iterations:
        found, width = _next_merges(state, iterations - len(merges), list(numbers), task_chars, width)
        if not found:
            break
        coded = []
        for a, b, _ in found:
            both = numbers.setdefault(a + b, _FIRST + len(numbers))
            coded.append((*(numbers[x] if len(x) > 1 else ord(x) for x in (a, b)), both))
        merges += found
        before, state = state, cut_lineage(state.mapInArrow(_applied(coded), "symbols binary, n bigint"))
        discard(before)
    return state.mapInArrow(_named(list(numbers)), "symbols array<string>, n bigint"), merges


def common_byte_pairs(words: DataFrame, column: str, iterations: int, min_length: int = 1) -> DataFrame:
    """``(symbol, n)`` of the merged symbols of at least ``min_length`` characters."""
    state, _ = byte_pairs(words, column, iterations)
    counted = state.select("n", F.explode("symbols").alias("symbol")).where(F.length("symbol") >= min_length)
    return counted.groupBy("symbol").agg(F.sum("n").alias("n"))


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).rlike(pattern))


def is_relevant(column: Column, patterns: list[str]) -> Column:
    """Whether none of the patterns is found; nulls are relevant."""
    return ~F.coalesce(column.rlike("|".join(patterns)), F.lit(False)) if patterns else F.lit(True)


def match_share(df: DataFrame, condition: Column) -> DataFrame:
    """One row ``(n_matching, n_total, percentage)``; 0 percent of an empty table."""
    return df.agg(F.count_if(condition).alias("n_matching"), F.count("*").alias("n_total")).withColumn("percentage", F.coalesce(F.try_divide(100.0 * F.col("n_matching"), F.col("n_total")), F.lit(0.0)))


def crawl_history(df: DataFrame, crawled: str) -> DataFrame:
    """``(day, n, is_peak)`` of the crawl times ``yyyy-MM-ddTHH:mm:ss.SSSSSS``; others are left out."""
    day = F.to_date(F.try_to_timestamp(F.col(crawled), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    counts = df.select(day.alias("day")).where(F.col("day").isNotNull()).groupBy("day").agg(F.count("*").alias("n"))
    peak = counts.agg(F.max("n").alias("peak"))
    return counts.crossJoin(F.broadcast(peak)).select("day", "n", (F.col("n") == F.col("peak")).alias("is_peak"))  # one row
