"""Problem 10: long exact spans that records share, by recompression.

A text is a string of word symbols (characters, in very long words). Rounds of block and
pair compression name short runs of one symbol and pairs of a left and a right symbol. A name
is a hash of what it stands for, and whether a symbol is left or right depends on the symbol
and the round only, so the names are the same in every task without any exchange: equal
substrings get equal symbols inside, and only a few symbols at their ends depend on the
surroundings. Symbols of ``SYMBOL_CHARS`` characters are not compressed further and long runs
not at all, which keeps that margin small.

Neighbouring symbols that together cover ``KEY_CHARS`` characters form a key; of the keys that
begin within ``CHOICE_CHARS`` characters the one with the least name is chosen, so texts with
a common span choose a common key inside it. Keys of several texts reveal candidates, which
are then made exact in three steps that never compare two texts:

* ``near`` windows, a little shorter than ``length``, lie at fixed distances around the places
  of shared keys. Every common span has one that both texts have.
* ``full`` windows of ``length`` characters at the same places prove a common span.
* Where the texts of a near window are not those of some full window, all windows of
  ``length`` characters around it are taken.

The result is sets of texts with a common window, one form for all sizes: rows grow with the
occurrences of passages, not with pairs. Exact copies are one class, its least key; spans
and links are found between classes, and ``sharing_pairs`` opens them where pairs are asked
for. Nothing depends on how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, discard

LENGTH = 200
#: Symbols of so many characters are not compressed further.
SYMBOL_CHARS = 8
#: Runs of so many characters are no blocks: their count would depend on the surroundings.
RUN_CHARS = 16
#: Characters that the symbols of a key cover at least.
KEY_CHARS = 48
#: One of the keys that begin within so many characters is chosen.
CHOICE_CHARS = 80
LONG_WORD = 24
ROUNDS = 6
#: Distance of the windows around a key.
STEP = 40
#: Texts of a piece that is worked on at once, in characters; a longer text is one piece.
PIECE_CHARS = 2_000_000
#: Members of a set that one task pairs with all others of the set.
PAIRED_TEXTS = 1000

_SPREAD = np.random.default_rng(20240229).integers(1, 2**63, LONG_WORD + 1, dtype=np.uint64) | np.uint64(1)
#: Odd bases of the two polynomials of a window's fingerprint, and their inverses modulo 2**64.
_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a public 64-bit hash (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD1B54A32D192ED03)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _symbols(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, first character and size of the words of a text; a line end is a barrier (symbol 0)."""
    codes = _codes(text)
    n = len(codes)
    gap = (codes == 32) | (codes == 10)
    first = np.ones(n, dtype=bool)
    first[1:] = gap[:-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    # a word of more than LONG_WORD characters is cut into its characters
    wide = np.repeat(sizes > LONG_WORD, sizes)
    first |= wide
    first |= codes == 10
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    place = np.arange(n) - np.repeat(starts, sizes)
    # the blank behind a word belongs to its size only
    weighed = np.where(gap & (place > 0), np.uint64(0), (codes.astype(np.uint64) + np.uint64(1)) * _SPREAD[np.minimum(place, LONG_WORD)])
    symbols = _mix(np.add.reduceat(weighed, starts)) if n else np.empty(0, np.uint64)
    symbols[codes[starts] == 10] = 0
    return symbols, starts, sizes


def _open_neighbours(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of short symbols with a short one behind them."""
    open_ = (sizes < SYMBOL_CHARS) & (symbols != 0)
    return np.flatnonzero(open_[:-1] & open_[1:])


def recompress(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounds of block and pair compression; symbol 0 is never joined."""
    for number in range(rounds):
        near = _open_neighbours(symbols, sizes)
        if not len(near):
            break
        # blocks: short runs of one symbol
        same = near[symbols[near] == symbols[near + 1]]
        if len(same):
            new = np.ones(len(symbols), dtype=bool)
            new[same + 1] = False
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(symbols)))
            whole = np.add.reduceat(sizes, at)
            new |= np.repeat((times > 1) & (whole >= RUN_CHARS), times)
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(symbols))).astype(np.uint64)
            whole = np.add.reduceat(sizes, at)
            symbols = np.where(times > 1, _pair(symbols[at], times ^ np.uint64(0xA5A5A5A5)), symbols[at])
            starts, sizes = starts[at], whole
            near = _open_neighbours(symbols, sizes)
        # pairs: a left symbol and the right one behind it
        turn = np.uint64((number * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        left = ~(_mix(symbols[near] + turn) >> np.uint64(63)).astype(bool)
        at = near[left]
        at = at[(_mix(symbols[at + 1] + turn) >> np.uint64(63)).astype(bool)]
        if not len(at):
            continue
        symbols, sizes = symbols.copy(), sizes.copy()
        symbols[at] = _pair(symbols[at], symbols[at + 1])
        sizes[at] += sizes[at + 1]
        kept = np.ones(len(symbols), dtype=bool)
        kept[at + 1] = False
        symbols, starts, sizes = symbols[kept], starts[kept], sizes[kept]
    return symbols, starts, sizes


def span_keys(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen keys of a text (or of several with line ends between) with first character and size."""
    symbols, starts, sizes = recompress(*_symbols(text))
    n = len(symbols)
    ends = np.cumsum(sizes)
    before = ends - sizes
    last = np.searchsorted(ends, before + KEY_CHARS, "left")
    barriers = np.cumsum(symbols == 0)
    good = (last < n) & (symbols != 0)
    good[good] = barriers[last[good]] == barriers[good]
    at = np.flatnonzero(good)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    key = symbols[at]
    width = last[at] - at
    more = np.arange(len(at))
    for k in range(1, int(width.max()) + 1):
        more = more[width[more] >= k]
        key[more] = _pair(key[more], symbols[at[more] + k])
    start, size, text_no = before[at], ends[last[at]] - before[at], barriers[at]
    # of the keys that begin within CHOICE_CHARS from each on, the last of the least
    reach = np.minimum(np.searchsorted(start, start + CHOICE_CHARS, "left"), np.searchsorted(text_no, text_no, "right"))
    count = reach - np.arange(len(at))
    least, best, more = key.copy(), np.arange(len(at)), np.arange(len(at))
    for k in range(1, int(count.max())):
        more = more[count[more] > k]
        other = key[more + k]
        better = other <= least[more]
        least[more[better]] = other[better]
        best[more[better]] = more[better] + k
    chosen = np.unique(best)
    return key[chosen], start[chosen], size[chosen]


def normal_text(text: str | None) -> str:
    """Every white-space run one blank, trimmed."""
    return " ".join(text.split()) if text else ""


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _keys(length: int):
    """``(span_key, rest, doc)``: chosen keys, and the two halves of the digest of each text (``rest`` not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["span_key", "rest", "doc"]

        def piece(texts: list[str], docs: list) -> pa.RecordBatch:
            key, start, _ = span_keys("\n".join(texts))
            offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
            which = np.searchsorted(offsets, start, "right") - 1
            once = _first_places(key, which)
            return pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64)), pa.nulls(len(once), pa.int64()), docs.take(pa.array(which[once]))], names=names)

        for batch in batches:
            of = batch.column(0)
            texts, rows, filled = [], [], 0
            every, digests = [], []
            seen: set[bytes] = set()
            for row, value in enumerate(batch.column(1)):
                text = normal_text(value.as_py())
                if len(text) < length:
                    continue
                digest = _digest(text)
                every.append(row)
                digests.append(digest)
                if digest in seen:  # a copy within the batch: its class is known by its digest
                    continue
                seen.add(digest)
                texts.append(text)
                rows.append(row)
                filled += len(text)
                if filled > PIECE_CHARS:
                    yield piece(texts, of.take(pa.array(rows, pa.int64())))
                    texts, rows, filled = [], [], 0
            if texts:
                yield piece(texts, of.take(pa.array(rows, pa.int64())))
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), of.take(pa.array(every, pa.int64()))], names=names)

    return run


class _Prints:
    """128-bit fingerprints of the windows of a text, by two polynomials over 64-bit values of its characters."""

    def __init__(self, text: str):
        codes = _codes(text).astype(np.uint64)
        n = len(codes)
        self.sums, self.back = [], []
        for k, (base, inverse) in enumerate(zip(_BASES, _INVERSES)):
            value = _mix(codes + np.uint64(k * 0x632BE59BD9B4E019 + 1))
            powers, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(x))]), dtype=np.uint64)[:n] for x in (base, inverse))
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(value * powers, dtype=np.uint64)]))
            self.back.append(back)

    def of(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        made = [_mix((sums[starts + size] - sums[starts]) * back[starts]) for sums, back in zip(self.sums, self.back)]
        return made[0].view(np.int64), made[1].view(np.int64)


class _Piece:
    """Some texts of a batch, with a line end between them."""

    def __init__(self, rows: list[int], texts: list[str]):
        self.rows = np.array(rows, dtype=np.int64)
        self.text = "\n".join(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes

    def number(self, place: np.ndarray) -> np.ndarray:
        """Which text each character lies in."""
        return np.searchsorted(self.ends, place, "left")

    def inside(self, first: np.ndarray, number: np.ndarray, width: int) -> np.ndarray:
        """Which windows from ``first`` lie wholly in the text ``number``."""
        return (first >= self.begins[number]) & (first + width <= self.ends[number])

    def batch(self, docs: pa.Array, number: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, full: bool) -> pa.RecordBatch:
        columns = [docs.take(pa.array(self.rows[number])), pa.array(a), pa.array(b), pa.array((at - self.begins[number]).astype(np.int32)), pa.array(np.full(len(at), full))]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "print_a", "print_b", "start", "full"])


def _pieces(texts: pa.Array) -> Iterator[_Piece]:
    rows, held, filled = [], [], 0
    for row, value in enumerate(texts):
        text = value.as_py()
        rows.append(row)
        held.append(text)
        filled += len(text)
        if filled > PIECE_CHARS:
            yield _Piece(rows, held)
            rows, held, filled = [], [], 0
    if rows:
        yield _Piece(rows, held)


def _given(batch: pa.RecordBatch, piece: _Piece, column: int) -> tuple[pa.Array, np.ndarray]:
    """What the rows of a piece were given, flat, with the number of its text."""
    lists = batch.column(column).take(pa.array(piece.rows))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(piece.rows)), sizes)


def _of_text(value: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A value within a text as one number; two that meet by chance add candidates, no results."""
    return _pair(value.view(np.uint64), number.astype(np.uint64))


def _first_places(*columns: np.ndarray) -> np.ndarray:
    """Rows, in order, without those whose columns stood before."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    order = np.lexsort(columns)  # stable: the first of equal rows stays first
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return np.sort(order[new])


_WINDOWS = "doc {kind}, print_a bigint, print_b bigint, start int, full boolean"


def _near_windows(length: int):
    """Near and full windows at fixed distances around the places of the given keys, each once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch.column(1)):
                wanted, owner = _given(batch, piece, 2)
                key, start, _ = span_keys(piece.text)
                number = piece.number(start)
                hit = np.isin(_of_text(key, number), _of_text(wanted.to_numpy(zero_copy_only=False), owner))
                shift = np.arange(0, length - KEY_CHARS + 1, STEP)
                first, number = (start[hit][:, None] - shift[None, :]).ravel(), np.repeat(number[hit], len(shift))
                prints = _Prints(piece.text)
                for width in (length - STEP + 1, length):
                    good = piece.inside(first, number, width)
                    at, whose = first[good], number[good]
                    a, b = prints.of(at, width)
                    once = _first_places(a, b, whose)
                    yield piece.batch(batch.column(0), whose[once], a[once], b[once], at[once], width == length)

    return run


def _all_windows(length: int, once: bool):
    """All windows of ``length`` characters that hold a near window with one of the given fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = length - STEP + 1
        for batch in batches:
            for piece in _pieces(batch.column(1)):
                wanted, owner = _given(batch, piece, 2)
                known = [wanted.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
                prints = _Prints(piece.text)
                every = np.arange(max(0, len(piece.text) - width + 1))
                number = piece.number(every)
                good = piece.inside(every, number, width)
                every, number = every[good], number[good]
                a, b = prints.of(every, width)
                near = every[np.isin(_of_text(a, number), _of_text(known[0], owner)) & np.isin(_of_text(b, number), _of_text(known[1], owner))]
                marks = np.zeros(len(piece.text) + 2, dtype=np.int64)
                np.add.at(marks, np.maximum(near - STEP + 1, 0), 1)
                np.add.at(marks, near + 1, -1)
                at = np.flatnonzero(np.cumsum(marks))
                number = piece.number(at)
                good = piece.inside(at, number, length)
                at, number = at[good], number[good]
                a, b = prints.of(at, length)
                if once:
                    kept = _first_places(a, b, number)
                    a, b, at, number = a[kept], b[kept], at[kept], number[kept]
                yield piece.batch(batch.column(0), number, a, b, at, True)

    return run


def _normal_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normal_text(v) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], names=["doc", "text", "keys"])


_PRINT = ["print_a", "print_b"]
_SET = ["n", "sign", "twist"]


def _sets(windows: DataFrame) -> DataFrame:
    """``(print_a, print_b, n, sign, twist)`` of windows that several texts have; the last three tell a set of texts.

    ``windows`` has a text once a window.
    """
    signed = windows.groupBy(*_PRINT).agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("doc").bitwiseAND((1 << 40) - 1)).alias("sign"),
        F.bit_xor(F.xxhash64("doc", F.lit(7))).alias("twist"),
    )
    return signed.where(F.col("n") > 1)


def _one_a_set(sets: DataFrame) -> DataFrame:
    return sets.groupBy(*_SET).agg(F.min(F.struct(*_PRINT)).alias("p")).select("p.*", *_SET)


@dataclass
class Candidates:
    """Texts that share something. ``doc`` is a class of copies (its least key).

    ``texts`` ``(doc, text, keys)``: their normal texts; ``windows`` ``(doc, print_a, print_b,
    start, full)``: near and full windows around shared keys; ``classes`` ``(doc, class)``.
    """

    texts: DataFrame
    windows: DataFrame
    classes: DataFrame
    length: int
    kind: str


def candidates(documents: DataFrame, key: str, text: str, length: int = LENGTH) -> Candidates:
    """Texts with a key in common, and the windows around these keys.

    White-space runs count as one blank and texts are trimmed first; positions refer to that
    form. Rows with a null key or text and shorter texts share nothing; keys are unique.
    ``length`` must be at least ``LENGTH``, for which keys are chosen densely enough.
    """
    if length < LENGTH:
        raise ValueError(f"length must be at least {LENGTH}")
    kind = documents.schema[key].dataType.simpleString()
    texts = documents.where(F.col(key).isNotNull() & (F.length(text) >= length)).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    named = cut_lineage(texts.mapInArrow(_keys(length), f"span_key bigint, rest bigint, doc {kind}"))
    digests = named.where(F.col("rest").isNotNull())
    least = digests.groupBy("span_key", "rest").agg(F.min("doc").alias("class"))
    classes = cut_lineage(digests.join(least, ["span_key", "rest"]).select("doc", "class"))
    keys = named.where(F.col("rest").isNull()).select("span_key", "doc")
    # partial minima and maxima, so that a key of very many texts is a row a task
    shared = keys.groupBy("span_key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where(F.col("lo") < F.col("hi")).select("span_key")
    # written first, so that the planner knows its size before it moves the keys
    shared = cut_lineage(shared)
    several = keys.join(shared, "span_key").join(classes, "doc")
    wanted = several.groupBy(F.col("class").alias("doc")).agg(F.collect_set("span_key").alias("keys"))
    found = texts.join(wanted, "doc").select("doc", "text", "keys").mapInArrow(_normal_texts, f"doc {kind}, text string, keys array<bigint>")
    found = cut_lineage(found)
    discard(named, shared)
    windows = cut_lineage(found.mapInArrow(_near_windows(length), _WINDOWS.format(kind=kind)))
    return Candidates(found, windows, classes, length, kind)


def shared_sets(found: Candidates) -> DataFrame:
    """``(print_a, print_b, doc)``: sets of texts that have a window of ``length`` characters in common.

    Of equal sets one is kept; a pair of texts has a common span if and only if a set holds both.
    """
    full, near = found.windows.where("full"), found.windows.where("not full")
    proven = cut_lineage(_one_a_set(_sets(full)))
    known = _sets(near)
    # near windows of a set of texts that a full window has too say nothing new
    open_ = known.join(proven.select(*_SET), _SET, "left_anti").select(*_PRINT)
    rest = near.join(open_, _PRINT).groupBy("doc").agg(F.collect_list(F.struct(*_PRINT)).alias("prints"))
    inside = found.texts.join(rest, "doc").select("doc", "text", "prints").mapInArrow(_all_windows(found.length, True), _WINDOWS.format(kind=found.kind))
    inside = cut_lineage(inside)
    more = _one_a_set(_sets(inside))
    of_full = full.join(proven.select(*_PRINT), _PRINT).select(*_PRINT, "doc")
    of_rest = inside.join(more.select(*_PRINT), _PRINT).select(*_PRINT, "doc")
    return of_full.unionByName(of_rest).distinct()


def _pairs(members: DataFrame, group: list[str]) -> DataFrame:
    """``(a, b)``, ``a < b``, of the members ``doc`` of each group; a large group is spread over tasks."""
    sized = members.groupBy(*group).agg(F.ceil(F.count("*") / PAIRED_TEXTS).cast("int").alias("parts"))
    sized = members.join(sized, group)
    left = sized.select(*group, F.col("doc").alias("a"), F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"))
    right = sized.select(*group, F.col("doc").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, [*group, "part"]).where(F.col("a") < F.col("b")).select("a", "b")


def links(found: Candidates) -> DataFrame:
    """Pairs of classes ``(a, b)``, ``a < b``, that have a common span, each once."""
    return _pairs(cut_lineage(shared_sets(found)), _PRINT).distinct()


def sharing_pairs(found: Candidates) -> DataFrame:
    """Pairs of documents ``(doc_a, doc_b)``, ``doc_a < doc_b``, with a common span: links and copies opened."""
    classes = found.classes
    copied = classes.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("class")
    members = cut_lineage(classes.join(copied, "class").select("class", "doc"))
    opened = (
        links(found)
        .join(members.select(F.col("class").alias("a"), F.col("doc").alias("a_doc")), "a", "left")
        .join(members.select(F.col("class").alias("b"), F.col("doc").alias("b_doc")), "b", "left")
        .select(F.coalesce("a_doc", "a").alias("a"), F.coalesce("b_doc", "b").alias("b"))
    )
    both = opened.unionByName(_pairs(members, ["class"]))
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def class_table(documents: DataFrame, found: Candidates, key: str) -> DataFrame:
    """One row a document: ``(key, class, n_copies, n_links)``.

    ``class`` is the least key of the texts that equal it in normal form, ``n_links`` the
    number of other classes with a common span. Texts too short to share are their own class.
    Rows with a null key are left out.
    """
    classes = found.classes
    sized = classes.groupBy("class").agg(F.count("*").alias("n_copies"))
    pairs = cut_lineage(links(found))
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))
    linked = ends.groupBy("class").agg(F.count("*").alias("n_links"))
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("doc")).join(classes, "doc", "left")
    rows = rows.join(sized, "class", "left").join(linked, "class", "left")
    return rows.select(F.col("doc").alias(key), F.coalesce("class", "doc").alias("class"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def shared_windows(found: Candidates) -> DataFrame:
    """``(print_a, print_b, doc, start)``: every window of ``length`` characters that several classes have."""
    near = found.windows.where("not full")
    several = near.join(_sets(near).select(*_PRINT), _PRINT).groupBy("doc").agg(F.collect_list(F.struct(*_PRINT)).alias("prints"))
    windows = found.texts.join(several, "doc").select("doc", "text", "prints").mapInArrow(_all_windows(found.length, False), _WINDOWS.format(kind=found.kind))
    windows = cut_lineage(windows.select(*_PRINT, "doc", "start"))
    both = windows.groupBy(*_PRINT).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where(F.col("lo") < F.col("hi"))
    return windows.join(both.select(*_PRINT), _PRINT)


def span_table(found: Candidates) -> DataFrame:
    """``(doc_a, doc_b, start_a, start_b, size)``: the spans of each class with the least class that has them.

    Every window of ``length`` characters that several classes have is told of each of them with
    the least one; windows that follow each other in both are one span. Rows grow with the
    occurrences of a passage, not with its pairs. Windows of one text that are equal and
    overlap (a run, a repeated word) meet those of the least class in order, so that neighbours
    keep their distance.
    """
    windows = cut_lineage(shared_windows(found))
    least = windows.groupBy(*_PRINT).agg(F.min("doc").alias("least"))
    own = Window.partitionBy(*_PRINT, "doc").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(own) >= found.length, F.lit(True)).cast("int")
    turns = windows.withColumn("apart", apart).withColumn("cluster", F.sum("apart").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    turns = turns.withColumn("turn", F.row_number().over(Window.partitionBy(*_PRINT, "doc", "cluster").orderBy("start")) - 1)
    turns = cut_lineage(turns.join(least, _PRINT))
    first = turns.where((F.col("doc") == F.col("least")) & (F.col("cluster") == 1))
    many = first.groupBy(*_PRINT).agg(F.count("*").cast("int").alias("turns"))
    others = turns.where(F.col("doc") != F.col("least")).join(many, _PRINT).withColumn("turn_a", F.pmod("turn", "turns"))
    linked = others.select(*_PRINT, "turn_a", "least", "doc", "start").join(first.select(*_PRINT, F.col("turn").alias("turn_a"), F.col("start").alias("a")), [*_PRINT, "turn_a"])
    linked = linked.select(F.col("least").alias("doc_a"), F.col("doc").alias("doc_b"), "a", F.col("start").alias("b"))
    # of one distance, windows that follow each other are one span
    side = Window.partitionBy("doc_a", "doc_b", F.col("b") - F.col("a")).orderBy("a")
    islands = linked.withColumn("island", F.col("a") - F.row_number().over(side))
    merged = islands.groupBy("doc_a", "doc_b", (F.col("b") - F.col("a")).alias("shift"), "island").agg(F.min("a").alias("start_a"), F.min("b").alias("start_b"), (F.max("a") - F.min("a") + found.length).alias("size"))
    return merged.select("doc_a", "doc_b", "start_a", "start_b", "size")


def shared_parts(documents: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """How much of each document also stands elsewhere: ``(key, n_chars, shared_chars, shared_share)``.

    Documents with a null key have no row; texts shorter than ``length`` share nothing, copies
    share all.
    """
    found = candidates(documents, key, text, length)
    classes = found.classes
    sized = classes.groupBy("class").agg(F.count("*").alias("copies"))
    # union of windows: each adds what lies beyond the one before it
    after = F.lead("start").over(Window.partitionBy("doc").orderBy("start"))
    added = F.least(F.lit(length), F.coalesce(after - F.col("start"), F.lit(length)))
    covered = shared_windows(found).withColumn("added", added).groupBy(F.col("doc").alias("class")).agg(F.sum("added").alias("shared"))
    normal = F.trim(F.regexp_replace(F.col(text), r"(?U)[\s\x1c-\x1f]+", " "))
    plain = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.coalesce(F.length(normal), F.lit(0)).alias("n_chars"))
    joined = plain.join(classes, "doc", "left").join(sized, "class", "left").join(covered, "class", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("long")
    return joined.select(F.col("doc").alias(key), "n_chars", shared.alias("shared_chars"), F.coalesce(F.try_divide(shared, "n_chars"), F.lit(0.0)).alias("shared_share"))
