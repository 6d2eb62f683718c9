"""Ranked wordlists: top with ties, core terms, redundancy, query strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def top_with_ties(df: DataFrame, by: str, top: int) -> DataFrame:
    """The ``top`` rows by a column, largest first, and all rows that tie with the last.

    The cutoff value comes from a top-k (a heap per partition), so no task sorts all rows. The
    rows are written once and read twice. Null values never count.
    """
    known = cut_lineage(df.where(F.col(by).isNotNull()))
    cutoff = known.select(F.col(by).alias("v")).orderBy(F.col("v").desc()).limit(top).agg(F.min("v").alias("cutoff"))
    return known.crossJoin(F.broadcast(cutoff)).where(F.col(by) >= F.col("cutoff")).drop("cutoff")  # one row


def top_with_core(df: DataFrame, core: DataFrame, by: str, top: int, term: str = "term") -> DataFrame:
    """Top rows beside the core terms, and the core terms; those that are missing get 0 in every column.

    ``core`` has the column ``term``; both are compared as they are.
    """
    names = core.select(F.col("term").alias(term)).where(F.col(term).isNotNull()).distinct()
    others = top_with_ties(df.join(names, term, "left_anti"), by, top)
    rows = names.join(df, term, "left")
    filled = rows.select([F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) if c != term and t in ("int", "bigint", "double", "float") else F.col(c) for c, t in df.dtypes])
    return others.unionByName(filled.select(others.columns))


def without_redundant(df: DataFrame, term: str, by: str) -> DataFrame:
    """Drop n-grams that contain an n-gram ranked before them (larger ``by``, then larger term).

    Dropped rows still make others redundant; the same term again is redundant too.
    """
    # the rank holds the term, so it tells a row; rows of one rank are redundant to each other
    ranked = df.select("*", F.struct(F.col(by), F.col(term)).alias("__rank"))
    n = F.size(term)
    sizes = F.sequence(F.lit(1), n)
    subs = F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(term, i, k)))))
    inside = ranked.where(n > 0).select("__rank", F.explode(subs).alias("__sub"))
    best = ranked.groupBy(F.col(term).alias("__sub")).agg(F.max("__rank").alias("__first"))
    redundant = inside.join(best, "__sub").where(F.col("__first") > F.col("__rank")).select(F.col("__rank").alias("__gone")).distinct()
    kept = ranked.join(redundant, F.col("__rank").eqNullSafe(F.col("__gone")), "left_anti")
    again = F.row_number().over(Window.partitionBy(term).orderBy(F.col("__rank").desc(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
    return kept.withColumn("__again", again).where(F.col("__again") == 1).drop("__again", "__rank")


def query_string(words: DataFrame, term: str = "term", order: str = "ord", separator: str = "|") -> DataFrame:
    """One row ``(query)``: the terms in order, joined by the separator between blanks."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.array_join(term, " ").alias("t"))))
    return words.agg(F.array_join(F.transform(listed, lambda x: x["t"]), f" {separator} ").alias("query"))


def combined_scores(left: DataFrame, right: DataFrame, term: str = "term") -> DataFrame:
    """Outer join of two rankings by term, rows with all scores only."""
    joined = left.join(right, term, "full")
    return joined.dropna()
