"""Duplicate elements of article markup, duplicate texts and addresses."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import markup_to_text

ELEMENTS = ["p", "li", "h1", "h2", "h3", "h4", "td", "span"]


def elements(df: DataFrame, doc_id: str, markup: str, names: list[str] = ELEMENTS) -> DataFrame:
    """``(doc_id, pos, name, text)``: elements of simple markup in document order.

    Tags inside an element become blanks in its text, white space is reduced; empty texts are
    left out. Unclosed elements end where the next of the listed elements begins or ends.
    """
    listed = "|".join(names)
    pattern = rf"(?i)<({listed})\b[^>]*>([^<]*+(?:<(?!/?(?:{listed})\b)[^<]*+)*+)"
    content = F.coalesce(F.col(markup), F.lit(""))
    tags = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(content, F.lit(pattern), F.lit(2))
    opened = df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.arrays_zip(tags.alias("name"), texts.alias("text"))).alias("pos", "e"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("e.text", "<[^>]*>", " "), r"(?U)\s+", " "))
    return opened.select("doc_id", "pos", F.lower("e.name").alias("name"), plain.alias("text")).where(F.col("text") != "")


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Tree(HTMLParser):
    """Elements of markup in order, each with the text of all that stands in it; ``gone`` ones leave the markup."""

    def __init__(self, gone: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.names: list[str] = []
        self.texts: list[list[str]] = []
        self.kept: list[str] = []
        self._gone = gone
        self._open: list[int] = []
        self._dropped = 0

    def handle_starttag(self, tag, attrs):
        number = len(self.names)
        self.names.append(tag)
        self.texts.append([])
        if number in self._gone:
            self._dropped += tag not in _VOID
        elif not self._dropped:
            self.kept.append(f"<{tag}>")
        if tag not in _VOID:
            self._open.append(number)

    def handle_endtag(self, tag):
        at = [k for k, number in enumerate(self._open) if self.names[number] == tag]
        if not at:
            return
        for number in self._open[at[-1] :]:
            self._dropped -= number in self._gone
        del self._open[at[-1] :]
        if not self._dropped:
            self.kept.append(f"</{tag}>")

    def handle_data(self, data):
        if data.strip():
            for number in self._open:
                self.texts[number].append(data.strip())
        if not self._dropped:
            self.kept.append(html.escape(data, quote=False))


def _tree(markup: str | None, gone: frozenset[int] = frozenset()) -> _Tree:
    tree = _Tree(gone)
    tree.feed(markup or "")
    tree.close()
    return tree


def nested_elements(df: DataFrame, doc_id: str, markup: str) -> DataFrame:
    """``(doc_id, pos, name, text)`` of every element, the ones around others too, in document order.

    The text of an element is that of its stretches of text at any depth, trimmed and joined
    by blanks; elements without text have an empty one. Null markup has no elements.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                tree = _tree(value)
                at += [k] * len(tree.names)
                rows += [(pos, name, " ".join(parts)) for pos, (name, parts) in enumerate(zip(tree.names, tree.texts))]
            columns = list(zip(*rows)) or [[]] * 3
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], names=["doc_id", "pos", "name", "text"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(markup).alias("markup")).mapInArrow(run, f"doc_id {kind}, pos int, name string, text string")


def without_elements(df: DataFrame, doc_id: str, markup: str, criterion: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``(doc_id, text_deduped, n_removed)``: the text of each markup without the elements that a criterion
    removes, and all that stands in them.

    Elements are counted over all documents by name and text; the count of one that occurs once
    is 0. Documents have unique keys; null markup has an empty text.
    """
    kind = df.schema[doc_id].dataType.simpleString()
    found = nested_elements(df, doc_id, markup)
    counted = found.withColumn("h", F.xxhash64("name", "text")).join(duplicate_elements(found).withColumn("h", F.xxhash64("name", "text")), ["h", "name", "text"], "left")
    gone = counted.where(F.coalesce(criterion(F.col("name"), F.col("text"), F.coalesce("n", F.lit(0))), F.lit(False)))
    places = gone.groupBy("doc_id").agg(F.collect_list("pos").alias("gone"))
    joined = df.select(F.col(doc_id).alias("doc_id"), F.col(markup).alias("markup")).join(places, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            rest = ["".join(_tree(value, frozenset(gone or ())).kept) for value, gone in zip(batch.column(1).to_pylist(), lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rest, pa.string()), pa.array([len(x or ()) for x in lists], pa.int32())], names=["doc_id", "rest", "n_removed"])

    left = joined.mapInArrow(run, f"doc_id {kind}, rest string, n_removed int")
    return left.select("doc_id", markup_to_text(F.col("rest")).alias("text_deduped"), "n_removed")


def duplicate_elements(found: DataFrame, minimum: int = 2) -> DataFrame:
    """``(name, text, n)`` of the elements that occur at least ``minimum`` times in all documents."""
    return found.groupBy("name", "text").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)


def paragraph_repeated(name: Column, text: Column, n: Column) -> Column:
    """Paragraphs that occur more than three times."""
    return (name == "p") & (n > 3)


def markup_repeated(name: Column, text: Column, n: Column) -> Column:
    """Inline and cell elements always; long paragraphs from the third, headings and paragraphs from the sixth time."""
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return name.isin("span", "td") | ((name == "p") & (blanks > 10) & (n > 2)) | (name.isin("h1", "h2", "h3", "p") & (n > 5))


def split_elements(duplicates: DataFrame, criterion: Callable[[Column, Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The duplicate elements that a criterion removes, and those it keeps."""
    gone = F.coalesce(criterion(F.col("name"), F.col("text"), F.col("n")), F.lit(False))
    return duplicates.where(gone), duplicates.where(~gone)


def deduplicated_texts(found: DataFrame, criterion: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``(doc_id, text_deduped, n_removed)``: the documents' elements without those the criterion removes.

    The count of an element that occurs once is 0. Documents that lose every element have an empty text.
    """
    counts = duplicate_elements(found)
    joined = found.join(counts, ["name", "text"], "left")
    gone = F.coalesce(criterion(F.col("name"), F.col("text"), F.coalesce("n", F.lit(0))), F.lit(False))
    marked = joined.select("doc_id", "pos", "text", gone.alias("gone"))
    kept = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("pos", "text"))))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n").alias("text_deduped"), F.count_if("gone").alias("n_removed"))


def removed_texts(removed: DataFrame) -> DataFrame:
    """``(text)``: the removed elements' distinct texts, a row each."""
    return removed.select("text").distinct()


def write_removed(removed: DataFrame, path: str) -> None:
    """The same in order as text files, parted by blank lines; files follow each other in order."""
    removed_texts(removed).orderBy("text").select(F.concat("text", F.lit("\n")).alias("value")).write.mode("errorifexists").text(path)


def first_of(df: DataFrame, same: Column, order: str, keep_null: bool = False) -> DataFrame:
    """Of rows with an equal value the first by ``order``; with ``keep_null`` null values equal nothing.

    The rows are told apart by a fingerprint of the value, so long values are not shuffled twice.
    """
    marked = df.withColumn("__same", F.when(same.isNotNull(), F.sha2(same.cast("string"), 256)))
    ranked = marked.withColumn("__rank", F.row_number().over(Window.partitionBy("__same").orderBy(order)))
    if not keep_null:
        return ranked.where(F.col("__rank") == 1).drop("__same", "__rank")
    known = marked.where(F.col("__same").isNotNull())
    first = known.withColumn("__rank", F.row_number().over(Window.partitionBy("__same").orderBy(order))).where(F.col("__rank") == 1).drop("__rank")
    return first.unionByName(marked.where(F.col("__same").isNull())).drop("__same")
