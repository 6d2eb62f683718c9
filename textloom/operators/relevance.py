"""Query-term relevance of terms at document level (share of documents that hold core terms)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import edge_stopword
from ..session import cut_lineage
from .corpus import grams, ngrams


def normal_terms(terms: Iterable[str | Sequence[str]]) -> list[tuple[str, ...]]:
    """Terms as tuples; duplicates and other types are errors."""
    out = []
    for t in terms:
        if not isinstance(t, (str, tuple, list)):
            raise TypeError(f"a term is a string or a sequence of strings, not {type(t).__name__}")
        out.append((t,) if isinstance(t, str) else tuple(t))
    if len(set(out)) != len(out):
        raise ValueError("terms contain duplicates")
    return out


def term_table(spark, terms: Iterable[str | Sequence[str]]) -> DataFrame:
    rows = [(k, list(t)) for k, t in enumerate(normal_terms(terms))]
    return spark.createDataFrame(rows, "ord int, term array<string>")


#: Term lists of up to so many terms are looked up within each document's row, longer ones by a join.
LISTED_TERMS = 1000


def _listed(terms: DataFrame) -> dict[int, list[list[str]]] | None:
    """Terms by length, None if they are more than ``LISTED_TERMS``."""
    rows = terms.select("term").limit(LISTED_TERMS + 1).collect()
    if len(rows) > LISTED_TERMS:
        return None
    by_length: dict[int, list[list[str]]] = {}
    for r in rows:
        if r.term:
            by_length.setdefault(len(r.term), []).append(r.term)
    return by_length


def _held(by_length: dict[int, list[list[str]]]) -> Column:
    """The terms that a document holds, each once."""
    parts = [F.array_intersect(grams(n), F.array(*[F.array(*[F.lit(w) for w in t]) for t in found])) for n, found in sorted(by_length.items())]
    return F.concat(*parts) if parts else F.array().cast("array<array<string>>")


def terms_in_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(doc_id, term, ord)``: the terms of a list that each document contains."""
    by_length = _listed(terms)
    if by_length is not None:
        return docs.select("doc_id", F.explode(_held(by_length)).alias("term")).join(terms.select("term", "ord"), "term").select("doc_id", "term", "ord")
    lengths = [r[0] for r in terms.select(F.size("term")).distinct().collect()]
    parts = [ngrams(docs, n, None, True).join(terms.where(F.size("term") == n).select("term", "ord"), "term").select("doc_id", "term", "ord") for n in sorted(lengths) if n > 0]
    return reduce(DataFrame.unionByName, parts)


def core_counts(docs: DataFrame, core: DataFrame) -> DataFrame:
    """``(term, ord, term_count, cooc_count, qtr)`` of the core terms against each other."""
    hits = terms_in_documents(docs, core)
    per_doc = hits.groupBy("doc_id").agg(F.count("*").alias("k"), F.collect_list(F.struct("term", "ord")).alias("t"))
    counted = per_doc.select("k", F.explode("t").alias("t")).groupBy("t.term", "t.ord").agg(F.count("*").alias("term_count"), F.count_if(F.col("k") > 1).alias("cooc_count"))
    return counted.select("term", "ord", "term_count", "cooc_count", (F.col("cooc_count") / F.col("term_count")).alias("qtr"))


def baseline(docs: DataFrame, core: DataFrame, strict: bool = True) -> tuple[float, list[str]]:
    """Smallest share among the core terms, and its term (the first in order of ties).

    Core terms that no document holds are an error, or are passed over if not ``strict``; then at
    least one must be found.
    """
    size = core.count()
    if size < 2:
        raise ValueError("at least two core terms are needed")
    counts = core_counts(docs, core).orderBy("qtr", "ord").collect()
    if len(counts) < size and (strict or not counts):
        missing = {tuple(r.term) for r in core.collect()} - {tuple(r.term) for r in counts}
        raise ValueError(f"terms not found in the corpus: {sorted(missing)}")
    return counts[0].qtr, counts[0].term


def cooccurrence_counts(docs: DataFrame, core: DataFrame, n: int, stopwords: Iterable[str] | None = None) -> DataFrame:
    """``(term, term_count, cooc_count)`` of the n-grams that share a document with a core term."""
    by_length = _listed(core)
    # documents get the flag before their n-grams are opened
    if by_length is not None:
        flagged = docs.withColumn("core", F.when(F.size(_held(by_length)) > 0, True))
    else:
        flagged = docs.join(terms_in_documents(docs, core).select("doc_id").distinct().withColumn("core", F.lit(True)), "doc_id", "left")
    each = ngrams(cut_lineage(flagged.select("doc_id", "tokens", "core")), n, None, True, "core")
    counts = each.groupBy("term").agg(F.count("*").alias("term_count"), F.count("core").alias("cooc_count")).where(F.col("cooc_count") > 0)
    counts = counts.join(core.select("term"), "term", "left_anti")
    return counts.where(~edge_stopword(F.col("term"), stopwords)) if stopwords is not None else counts


def relevance(counts: DataFrame, base: float, metric: str = "rqtrn", min_docs: int = 1) -> DataFrame:
    """``(term, term_count, cooc_count, score)`` by the share itself or against the baseline."""
    q = F.col("cooc_count") / F.col("term_count")
    if metric == "qtr":
        score = q
    elif metric == "rqtr":
        if base == 0:
            raise ValueError("the baseline is 0")
        score = 100 * (q - base) / base
    elif metric == "rqtrn":
        if base == 1:
            raise ValueError("the baseline is 1")
        score = 100 * (q - base) / (1 - base)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return counts.where(F.col("term_count") >= min_docs).select("term", "term_count", "cooc_count", score.alias("score"))
