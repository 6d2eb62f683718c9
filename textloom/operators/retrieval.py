"""Retrieval of documents by wordlists and patterns under absolute or relative thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import java_flags, quoted


def encoded_tokens(tokens: Column) -> Column:
    """Tokens as one string in which every token is fenced, so matches keep to token borders."""
    return F.when(F.size(tokens) > 0, F.concat(F.lit("__"), F.array_join(tokens, "____"), F.lit("__"))).otherwise(F.lit(""))


def encoded_term(words: Sequence[str], escape: bool = True) -> str:
    return "__" + "____".join(quoted(w) if escape else w for w in words) + "__"


def alternation(terms: Sequence[str | Sequence[str]], escape: bool = True) -> str:
    """Terms as alternatives in their order: of those that match at one place the first wins."""
    return "|".join(encoded_term((t,) if isinstance(t, str) else t, escape) for t in terms)


def plain_matches(matches: Column) -> Column:
    """Matches without fences, words parted by a blank, empty ones dropped."""
    return F.filter(F.transform(matches, lambda m: F.trim(F.regexp_replace(m, "__+", " "))), lambda m: m != "")


def _hits(docs: DataFrame, pattern: str, source: Column, ignore_case: bool, fenced: bool, unique: bool) -> DataFrame:
    found = F.regexp_extract_all(source, F.lit(java_flags(pattern, ignore_case)), F.lit(0))
    matches = plain_matches(found) if fenced else found
    return docs.withColumn("matches", F.array_distinct(matches) if unique else matches).withColumn("n_hits", F.size("matches"))


def match_wordlist(docs: DataFrame, terms: Sequence[str | Sequence[str]], minimum: int = 1, unique: bool = False, escape: bool = True, ignore_case: bool = False) -> DataFrame:
    """``(doc_id, matches, n_hits)`` of documents with at least ``minimum`` hits (0: all documents).

    Hits do not overlap and are taken leftmost; ``unique`` counts different hits only.
    """
    if not terms:
        empty = docs.select("doc_id", F.array().cast("array<string>").alias("matches"), F.lit(0).alias("n_hits"))
        return empty if minimum <= 0 else empty.limit(0)
    hits = _hits(docs, alternation(terms, escape), encoded_tokens(F.col("tokens")), ignore_case, True, unique)
    return hits.where(F.col("n_hits") >= minimum).select("doc_id", "matches", "n_hits")


def match_wordlist_pmw(docs: DataFrame, terms: Sequence[str | Sequence[str]], minimum: float, unique: bool = False, escape: bool = True, ignore_case: bool = False) -> DataFrame:
    """``(doc_id, matches, n_hits, doc_len, pmw)`` of every document; below ``minimum`` hits per
    million words the matches are empty. Empty documents have a null rate and no matches."""
    hits = _hits(docs, alternation(terms, escape), encoded_tokens(F.col("tokens")), ignore_case, True, unique)
    rate = F.try_divide(F.col("n_hits") * F.lit(1e6), F.size("tokens"))
    enough = F.coalesce(rate >= minimum, F.lit(False))
    return hits.select(
        "doc_id",
        F.when(enough, F.col("matches")).otherwise(F.array().cast("array<string>")).alias("matches"),
        F.when(enough, F.col("n_hits")).otherwise(0).alias("n_hits"),
        F.size("tokens").alias("doc_len"),
        rate.alias("pmw"),
    )


def match_regex(docs: DataFrame, pattern: str, text: str, minimum: int = 1, unique: bool = False, ignore_case: bool = False, verbose: bool = False) -> DataFrame:
    """Documents by a pattern on raw text; a null text is an empty one."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(java_flags(pattern, ignore_case, verbose)), F.lit(0))
    hits = docs.select("doc_id", (F.array_distinct(found) if unique else found).alias("matches"))
    return hits.withColumn("n_hits", F.size("matches")).where(F.col("n_hits") >= minimum)


def match_regex_pmw(docs: DataFrame, pattern: str, text: str, minimum: float, unique: bool = False, ignore_case: bool = False, verbose: bool = False) -> DataFrame:
    """As ``match_regex``, the threshold per million words of the text (``\\b\\w+\\b``)."""
    content = F.coalesce(F.col(text), F.lit(""))
    found = F.regexp_extract_all(content, F.lit(java_flags(pattern, ignore_case, verbose)), F.lit(0))
    hits = docs.select("doc_id", (F.array_distinct(found) if unique else found).alias("matches"), F.regexp_count(content, F.lit(r"(?U)\b\w+\b")).alias("doc_len"))
    rated = hits.withColumn("n_hits", F.size("matches")).withColumn("pmw", F.try_divide(F.col("n_hits") * F.lit(1e6), F.col("doc_len")))
    return rated.where(F.col("pmw") >= minimum).select("doc_id", "matches", "n_hits", "doc_len", "pmw")


def match_weighted(docs: DataFrame, weights: dict[str | tuple[str, ...], float], minimum: float, unique: bool = False) -> DataFrame:
    """``(doc_id, matches, weight)``: documents whose hits' weights add up to ``minimum``.

    The matches are distinct; ``unique`` adds each term's weight once. Terms are taken in the
    order of ``weights``.
    """
    terms = [(t,) if isinstance(t, str) else tuple(t) for t in weights]
    table = F.create_map(*[F.lit(x) for t, w in zip(terms, weights.values()) for x in (" ".join(t), float(w))])
    hits = _hits(docs, alternation(terms), encoded_tokens(F.col("tokens")), False, True, unique)
    total = F.aggregate(F.transform("matches", lambda m: F.coalesce(F.try_element_at(table, m), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    return hits.select("doc_id", F.array_distinct("matches").alias("matches"), total.alias("weight")).where(F.col("weight") >= minimum)


def found_documents(docs: DataFrame, hits: DataFrame) -> DataFrame:
    return docs.join(hits.select("doc_id"), "doc_id", "left_semi")


def other_documents(docs: DataFrame, hits: DataFrame) -> DataFrame:
    return docs.join(hits.select("doc_id"), "doc_id", "left_anti")


def documents_by_keys(docs: DataFrame, column: str, values: Sequence) -> DataFrame:
    return docs.where(F.col(column).isin(list(values)))


def not_annotated(docs: DataFrame, hits: DataFrame, label: str) -> DataFrame:
    """Found documents without a label (null or empty)."""
    return found_documents(docs, hits).where(F.coalesce(F.col(label), F.lit("")) == "")


def gated(hits: DataFrame, docs: DataFrame, label: str, accepted: Sequence[str]) -> DataFrame:
    """Hits whose document has one of the accepted labels."""
    return hits.join(docs.where(F.col(label).isin(list(accepted))).select("doc_id"), "doc_id", "left_semi")
