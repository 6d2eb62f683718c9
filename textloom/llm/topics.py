"""Topics of documents for the margins of problem 9: spherical k-means over weighted words.

All documents are counted and fitted, by all their words. Frequencies come first; then every
text is a vector of the vocabulary's words, written once, and each step of k-means is a pass
over the vectors that returns sums by topic. Vectors and centres are whole numbers (a length
of 1 is ``UNIT``), small enough that their products and sums are exact, so the model does
not depend on the partitioning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard

VOCABULARY = 4_000
TOPICS = 8
ROUNDS = 10
#: Words of fewer letters say little about a topic.
LEAST_LETTERS = 4
#: Words in more than this share of the documents say little either.
MOST_SHARE = 0.3
#: Whole number for 1: products of two such are below 2^53, and so are the sums over a vector.
UNIT = 1 << 24
#: Different words that a task holds before it hands on their counts.
HELD_WORDS = 500_000
#: Entries of vectors that are worked on at once, unless one vector has more.
BLOCK_ENTRIES = 1_000_000

_WORD = re.compile(r"[^\W\d_]{%d,}" % LEAST_LETTERS)
_ENTRY = np.dtype([("at", "<u2"), ("share", "<i4")])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by word, of a task's documents; the null word counts all of them."""

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for value in batch.column(0):
            held[None] += 1
            held.update(set(_WORD.findall(value.as_py().lower())))
            if len(held) >= HELD_WORDS:
                yield counted()
                held.clear()
    if held:
        yield counted()


def _unit(values: np.ndarray) -> np.ndarray:
    """``values`` as a vector of length ``UNIT``."""
    return np.rint(values * (UNIT / max(float(np.linalg.norm(values)), 1e-12)))


class Vocabulary:
    """Words and their weights."""

    def __init__(self, words: list[str], idf: np.ndarray):
        if len(words) > 1 << 16:
            raise ValueError("a vocabulary has 65,536 words at most")
        self.numbers = {w: k for k, w in enumerate(words)}
        self.idf = idf

    def vectors(self, texts: list[str | None]) -> list[bytes]:
        """Numbers and weights of the known words of each text, of length ``UNIT``; empty where no word is known."""
        out: list[bytes] = []
        at, times, lengths = [], [], []
        for text in texts:
            counts = Counter(map(self.numbers.get, _WORD.findall(text.lower()))) if text else {}
            counts.pop(None, None)
            at += counts.keys()
            times += counts.values()
            lengths.append(len(counts))
            if len(at) >= BLOCK_ENTRIES:
                out += self._weighed(at, times, lengths)
                at, times, lengths = [], [], []
        return out + self._weighed(at, times, lengths)

    def _weighed(self, at: list[int], times: list[int], lengths: list[int]) -> list[bytes]:
        number, ends = np.array(at, np.int64), np.cumsum(lengths, dtype=np.int64)
        order = np.lexsort((number, np.repeat(np.arange(len(lengths)), lengths)))
        entries = np.empty(len(at), _ENTRY)
        entries["at"] = number = number[order]
        weight = np.log1p(np.array(times, float)[order]) * self.idf[number]
        some = np.array(lengths, np.int64)[np.flatnonzero(lengths)]
        if len(some):
            norm = np.sqrt(np.add.reduceat(weight * weight, np.cumsum(some) - some))
            entries["share"] = np.rint(weight * np.repeat(UNIT / norm, some))
        content = entries.tobytes()
        edges = [0, *(ends * _ENTRY.itemsize).tolist()]
        return [content[lo:hi] for lo, hi in zip(edges[:-1], edges[1:])]


class TopicModel:
    """A vocabulary and the centres of topics."""

    def __init__(self, vocabulary: Vocabulary, centres: np.ndarray):
        self.vocabulary, self.centres = vocabulary, centres


def fit_vocabulary(documents: DataFrame, key: str, text: str, size: int = VOCABULARY) -> Vocabulary:
    """Of the words of two documents or more, and not of too many, the ``size`` words of most documents.

    All documents with a key and a text are counted; without any the vocabulary is empty.
    """
    texts = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"))
    counts = texts.mapInArrow(_document_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.where(F.col("word").isNull() | (F.col("n") >= 2)))
    whole = counts.where(F.col("word").isNull()).first()
    usable = counts.where(F.col("word").isNotNull() & (F.col("n") <= MOST_SHARE * whole.n)).orderBy(F.desc("n"), "word").limit(size).collect() if whole else []
    discard(counts)
    return Vocabulary([r.word for r in usable], np.log(whole.n / np.array([r.n for r in usable], dtype=float)) if usable else np.zeros(0))


def _mapped(documents: DataFrame, column: str, name: str, kind: str, found) -> DataFrame:
    """The documents with a column that ``found`` makes of another one."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    at = documents.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, found(batch.column(at).to_pylist())], names=[*batch.schema.names, name])

    return documents.mapInArrow(run, f"{fields}, `{name}` {kind}")


def with_vectors(documents: DataFrame, text: str, vocabulary: Vocabulary, name: str = "vector") -> DataFrame:
    """The documents with the vector of their text."""
    return _mapped(documents, text, name, "binary", lambda texts: pa.array(vocabulary.vectors(texts), pa.binary()))


def _blocks(vectors: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the vectors that are not empty, by block: their places, lengths, word numbers and weights."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors)) // _ENTRY.itemsize
    places = np.flatnonzero(lengths)
    group = np.cumsum(lengths[places]) // BLOCK_ENTRIES
    for own in np.split(places, np.flatnonzero(np.diff(group)) + 1):
        if len(own):
            entries = np.frombuffer(b"".join([vectors[k] for k in own]), _ENTRY)
            yield own, lengths[own], entries["at"].astype(np.int64), entries["share"].astype(float)


def _products(centres: np.ndarray, lengths: np.ndarray, at: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Products of each centre with each vector of a block."""
    starts = np.cumsum(lengths) - lengths
    return np.array([np.add.reduceat(c[at] * share, starts) for c in centres])


def _sums(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Sum of the vectors that are nearest to each centre."""
    topics, words = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(topics * words, np.int64)
        for batch in batches:
            for _, lengths, at, share in _blocks(batch.column(0).to_pylist()):
                nearest = _products(centres, lengths, at, share).argmax(axis=0)
                total += np.bincount(np.repeat(nearest, lengths) * words + at, share, topics * words).astype(np.int64)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "total"])

    # at most a row a word and topic
    found = points.select("vector").mapInArrow(run, "cell bigint, total bigint").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(topics * words)
    out[found["cell"].to_numpy()] = found["total"].to_numpy()
    return out.reshape(topics, words)


def _extreme(points: DataFrame, centres: np.ndarray, sign: int) -> np.ndarray | None:
    """The vector farthest from its nearest centre (``sign`` 1) or nearest to it (-1); of equal ones that of least key hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            hashes, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for own, *block in _blocks(vectors):
                value = sign * _products(centres, *block).max(axis=0)
                least = own[value == value.min()]
                first = min((int(value.min()), int(hashes[k]), vectors[k]) for k in least[hashes[least] == hashes[least].min()])
                best = first if best is None else min(best, first)
        value, h, vector = ([x] for x in best) if best else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(h, pa.int64()), pa.array(vector, pa.binary())], names=["value", "h", "vector"])

    found = points.select("h", "vector").mapInArrow(run, "value bigint, h bigint, vector binary").agg(F.min(F.struct("value", "h", "vector")).alias("best")).first().best
    if found is None:
        return None
    entries = np.frombuffer(bytes(found.vector), _ENTRY)
    out = np.zeros(centres.shape[1])
    out[entries["at"]] = entries["share"]
    return out


def fit_centres(vectors: DataFrame, key: str, vector: str, words: int, topics: int = TOPICS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of all vectors with a key, a row a topic; ``vectors`` is read once a step, so it should be written."""
    points = vectors.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(vector).alias("vector"))
    # first centre: nearest to the mean; each next one: farthest from those before
    mean = _sums(points, np.zeros((1, words)))
    first = _extreme(points, np.array([_unit(mean[0])]), -1) if mean.any() else None
    if first is None:
        return np.zeros((1, words))
    centres = first[None]
    while len(centres) < topics:
        far = _extreme(points, centres, 1)
        if (centres == far).all(axis=1).any():
            break  # fewer different vectors than topics
        centres = np.vstack([centres, far])
    for _ in range(rounds):
        before, sums = centres, _sums(points, centres)
        centres = np.array([_unit(s) if s.any() else c for s, c in zip(sums, centres)])
        if (centres == before).all():
            break
    return centres


def with_nearest(vectors: DataFrame, vector: str, centres: np.ndarray, name: str = "topic") -> DataFrame:
    """The rows with the number of the nearest centre, -1 where the vector is empty; equal ones: the least."""

    def nearest(found: list[bytes]) -> pa.Array:
        out = np.full(len(found), -1, np.int32)
        for own, *block in _blocks(found):
            out[own] = _products(centres, *block).argmax(axis=0)
        return pa.array(out)

    return _mapped(vectors, vector, name, "int", nearest)


def fit_topics(documents: DataFrame, key: str, text: str, topics: int = TOPICS) -> TopicModel:
    """Vocabulary and centres of all documents; without documents a model that knows no word."""
    vocabulary = fit_vocabulary(documents, key, text)
    vectors = cut_lineage(with_vectors(documents.select(key, text), text, vocabulary).drop(text))
    model = TopicModel(vocabulary, fit_centres(vectors, key, "vector", len(vocabulary.idf), topics))
    discard(vectors)
    return model


def with_topics(documents: DataFrame, text: str, model: TopicModel, name: str = "topic") -> DataFrame:
    """The documents with the number of their topic."""
    return with_nearest(with_vectors(documents, text, model.vocabulary, "__vector"), "__vector", model.centres, name).drop("__vector")
