"""Corpora: one row a document with its tokens; n-grams and corpus statistics.

A corpus is a DataFrame ``(doc_id, tokens array<string>, ...)``. Null arrays count as empty,
null elements are dropped. Nothing relies on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import has_letter


def corpus(df: DataFrame, doc_id: str, tokens: str, *carry: str, keep: Callable[[Column], Column] | None = has_letter) -> DataFrame:
    """``(doc_id, tokens, *carry)`` with the tokens that ``keep`` accepts (None: all)."""
    if keep is not None and not callable(keep):
        raise TypeError("keep must be a function of a column, or None")
    words = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    words = F.filter(words, lambda w: w.isNotNull() & keep(w)) if keep else F.filter(words, lambda w: w.isNotNull())
    return df.select(F.col(doc_id).alias("doc_id"), words.alias("tokens"), *carry)


def treat_as_one(docs: DataFrame, words: Sequence[str], name: str | None = None) -> DataFrame:
    """Replace each non-overlapping occurrence of the word sequence by one token, left to right."""
    if not words:
        raise ValueError("no words given")
    n, joined = len(words), name if name is not None else " ".join(words)
    wanted = F.array(*[F.lit(w) for w in words])
    tokens = F.col("tokens")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

    def step(acc: Column, i: Column) -> Column:
        here = F.slice(tokens, i, F.lit(n)) == wanted
        return (
            F.when(acc["skip"] > 0, F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip")))
            .when(here, F.struct(F.concat(acc["out"], F.array(F.lit(joined))).alias("out"), F.lit(n - 1).alias("skip")))
            .otherwise(F.struct(F.concat(acc["out"], F.slice(tokens, i, F.lit(1))).alias("out"), F.lit(0).alias("skip")))
        )

    positions = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))
    replaced = F.aggregate(positions, start, step)["out"]
    # only documents with all the words need the pass
    return docs.withColumn("tokens", F.when(F.forall(F.array_distinct(wanted), lambda w: F.array_contains(tokens, w)), replaced).otherwise(tokens))


def words_as_one(docs: DataFrame, words: Sequence[str], name: str | None = None) -> DataFrame:
    """Replace every listed word by one name (default: the words joined by ``/``)."""
    joined = name if name is not None else "/".join(words)
    return docs.withColumn("tokens", F.transform("tokens", lambda w: F.when(w.isin(list(words)), F.lit(joined)).otherwise(w)))


def grams(n: int) -> Column:
    """All n-grams of ``tokens`` as an array of arrays, from shifted arrays zipped."""
    tokens = F.col("tokens")
    if n == 1:
        return F.transform(tokens, lambda w: F.array(w))
    length = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    zipped = F.arrays_zip(*[F.slice(tokens, k + 1, length).alias(f"w{k}") for k in range(n)])
    return F.transform(zipped, lambda z: F.array(*[z[f"w{k}"] for k in range(n)]))


def _kept(found: Column, keep: Callable[[Column], Column] | None) -> Column:
    return F.filter(found, lambda g: F.forall(g, keep)) if keep else found


def ngrams(docs: DataFrame, n: int, keep: Callable[[Column], Column] | None = None, distinct: bool = False, *carry: str) -> DataFrame:
    """``(doc_id, *carry, term array<string>)``: each contiguous n-gram whose words all pass ``keep``.

    With ``distinct`` each n-gram once a document, found within the row.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    found = _kept(grams(n), keep)
    return docs.where(F.size("tokens") >= n).select("doc_id", *carry, F.explode(F.array_distinct(found) if distinct else found).alias("term"))


def ngram_rows(docs: DataFrame, lengths: Sequence[int], keep: Callable[[Column], Column] | None = None, *carry: str) -> DataFrame:
    """``(*carry, term, first)``: every n-gram of the given lengths; ``first`` marks one of equal ones of a document.

    The n-grams of a document are sorted within its row, so equal ones are neighbours.
    """
    if not lengths or min(lengths) < 1:
        raise ValueError("n must be at least 1")
    each = [_kept(grams(n), keep) for n in lengths]
    rows = docs.where(F.size("tokens") >= min(lengths)).select(*carry, F.sort_array(F.concat(*each) if len(each) > 1 else each[0]).alias("g"))
    before = F.concat(F.array(F.lit(None).cast("array<string>")), F.slice("g", F.lit(1), F.size("g") - 1))
    opened = rows.where(F.size("g") > 0).select(*carry, F.explode(F.arrays_zip(F.col("g").alias("term"), before.alias("before"))).alias("z"))
    return opened.select(*carry, "z.term", (F.col("z.before").isNull() | (F.col("z.before") != F.col("z.term"))).alias("first"))


def ngram_counts(docs: DataFrame, n: int, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(term, freq, doc_freq)`` of the n-grams, by one aggregation with partial sums and one shuffle."""
    return ngram_rows(docs, [n], keep).groupBy("term").agg(F.count("*").alias("freq"), F.count_if("first").alias("doc_freq"))


def corpus_size(docs: DataFrame, n: int = 1) -> DataFrame:
    """One row ``(size)``: number of n-gram positions."""
    return docs.agg(F.coalesce(F.sum(F.greatest(F.size("tokens") - n + 1, F.lit(0))), F.lit(0)).cast("long").alias("size"))


def label_stats(docs: DataFrame, source: str, label: str, main: str, side: str) -> DataFrame:
    """Documents, main and side topic and annotated documents by source, with a total row."""
    has = F.coalesce(F.col(label) != "", F.lit(False))
    return (
        docs.rollup(source)
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col(label) == main).alias("main"),
            F.count_if(F.col(label) == side).alias("side"),
            F.count_if(has).alias("annotated"),
            F.grouping(source).alias("all"),
        )
        .select(F.when(F.col("all") == 1, F.lit("Total")).otherwise(F.col(source)).alias("source"), "total", "main", "side", "annotated")
    )
