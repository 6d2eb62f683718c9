"""Keyness of n-grams of a study corpus against a reference corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.association import keyness_metric
from ..functions.words import edge_stopword
from ..session import cut_lineage
from .corpus import ngram_rows


def contingency(study: DataFrame, reference: DataFrame, n: int | Sequence[int] = 1, smoothing: float = 1e-5, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(term, n, freq, doc_freq, o11, o12, o21, o22)`` of each n-gram of the study corpus.

    A corpus' size is the number of its n-grams that pass ``keep``; every length has its own
    sizes. The smoothing is added to both frequencies and, for each distinct n-gram, to the
    sizes. Both corpora and all lengths are counted in one pass with one shuffle.
    """
    lengths = [n] if isinstance(n, int) else sorted(set(n))
    both = study.select("tokens", F.lit(True).alias("mine")).unionByName(reference.select("tokens", F.lit(False).alias("mine")))
    each = ngram_rows(both, lengths, keep, "mine")
    counts = each.groupBy("term").agg(
        F.count_if("mine").alias("freq"),
        F.count_if(F.col("mine") & F.col("first")).alias("doc_freq"),
        F.count_if(~F.col("mine")).alias("freq_r"),
    )
    counts = cut_lineage(counts.withColumn("n", F.size("term")))
    # one row a length
    sizes = counts.groupBy(F.col("n").alias("of_n")).agg(
        F.sum("freq").alias("size_s"), F.count_if(F.col("freq") > 0).alias("unique_s"), F.sum("freq_r").alias("size_r"), F.count_if(F.col("freq_r") > 0).alias("unique_r")
    )
    s = F.lit(smoothing)
    joined = counts.where("freq > 0").join(F.broadcast(sizes), F.col("n") == F.col("of_n"))
    o11, o12 = F.col("freq") + s, F.col("freq_r") + s
    return joined.select(
        "term",
        "n",
        "freq",
        "doc_freq",
        o11.alias("o11"),
        o12.alias("o12"),
        (F.col("size_s") - o11 + s * F.col("unique_s")).alias("o21"),
        (F.col("size_r") - o12 + s * F.col("unique_r")).alias("o22"),
    )


def keywords_of_length(
    study: DataFrame,
    reference: DataFrame,
    n: int | Sequence[int],
    metric: str | Callable[..., Column] = "log_likelihood",
    smoothing: float = 1e-4,
    min_docs: int = 1,
    min_freq: int = 1,
    stopwords: Iterable[str] | None = None,
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(term, n, freq, doc_freq, keyness)`` of the n-grams of a length, or of several, that pass the limits."""
    measure = keyness_metric(metric)
    table = contingency(study, reference, n, smoothing, keep).where((F.col("doc_freq") >= min_docs) & (F.col("freq") >= min_freq))
    if stopwords is not None:
        table = table.where(~edge_stopword(F.col("term"), stopwords))
    return table.select("term", "n", "freq", "doc_freq", measure(*[F.col(c) for c in ("o11", "o12", "o21", "o22")]).alias("keyness"))


def keywords(study: DataFrame, reference: DataFrame, max_n: int = 3, **options) -> DataFrame:
    """Keywords of 1 to ``max_n`` words; every length has its own sizes."""
    return keywords_of_length(study, reference, range(1, max_n + 1), **options)
