"""Problem 6: lines repeated over one site's documents, by distributed PrefixSpan.

Each document is the sequence of its line keys. A sequence of lines is frequent if at
least ``support`` documents of the site contain it; its elements are adjacent lines, which is
what can be deleted as one stretch. Level 1 finds the frequent lines and names them by
128-bit identifiers; from then on documents are sequences of identifiers, and only
frequent lines are left. The projection of a prefix is the places behind its occurrences
(document and position, no copies of suffixes). Every level extends each frequent prefix by
the line at these places and keeps the extensions that are frequent again, until none is.

Supports are counted over documents with each sequence once, with partial counts, so
neither a site with a third of all documents nor a line in all of them fills one task. Lines
meet their identifiers in a join against one row an identifier, which Spark broadcasts where
the table of frequent lines is small and whose skewed keys it splits where it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard

SUPPORT = 5


def site_of(url: Column) -> Column:
    """Host in lower case without port and leading ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def line_keys(text: Column) -> Column:
    """Keys of the lines of a text: white space runs one blank, trimmed, lower case, digit runs ``0``."""
    whole = F.regexp_replace(F.lower(text), r"[0-9]+", "0")
    whole = F.regexp_replace(whole, r"(?U)[\s&&[^\n]]+", " ")
    return F.transform(F.split(whole, "\n"), lambda line: F.trim(line))


_ID = ["id_a", "id_b"]


def _name(*columns: Column) -> list[Column]:
    """A 128-bit name in two columns."""
    return [F.xxhash64(*columns).alias("id_a"), F.xxhash64(F.lit(11), *reversed(columns)).alias("id_b")]


def _lines(documents: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """``(doc, site, lines)``: the non-empty line keys of each document with a key, a site and a text."""
    keyed = documents.select(F.col(key).alias("doc"), F.col(site).alias("site"), line_keys(F.col(text)).alias("lines")).where(
        F.col("doc").isNotNull() & F.col("site").isNotNull() & F.col("lines").isNotNull()
    )
    return keyed.withColumn("lines", F.filter("lines", lambda x: x != ""))


def _frequent_lines(keyed: DataFrame, support: int, unique: bool) -> DataFrame:
    """Level 1: ``(id_a, id_b, site, line, n_documents)``."""
    first = keyed.select("site", "doc", F.explode(F.array_distinct("lines")).alias("line"))
    single = (first if unique else first.distinct()).groupBy("site", "line").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") >= support)
    return cut_lineage(single.select(*_name(F.col("site"), F.col("line")), "site", "line", "n_documents"))


def frequent_sequences(documents: DataFrame, key: str, site: str, text: str, support: int = SUPPORT, unique: bool = False) -> DataFrame:
    """Frequent sequences of adjacent lines of each site, of every length.

    ``documents`` has one row a document; rows with a null key, site or text are left out,
    rows with the same key count as one document (``unique`` says that there are none, which
    saves a shuffle). Empty lines are no elements and do not part their neighbours. Returns
    ``(site, lines array<string>, n_lines, n_documents)``.
    """
    keyed = cut_lineage(_lines(documents, key, site, text))
    single = _frequent_lines(keyed, support, unique)
    level = single.select(*_ID, "site", F.array("line").alias("lines"), "n_documents")
    found = level
    if unique:
        rows = keyed.withColumn("row", F.col("doc"))
    else:
        rows = keyed.withColumn("row", F.struct("doc", F.xxhash64("site", "lines"), F.hash("lines", "site")))
    placed = rows.select("doc", "row", "site", F.posexplode("lines").alias("pos", "line")).select("doc", "row", "pos", *_name(F.col("site"), F.col("line")))
    placed = cut_lineage(placed.join(single.select(*_ID), _ID).distinct())
    discard(keyed)
    before = None
    grown = placed.select("doc", "row", F.col("pos").alias("last"), *_ID)
    while True:
        # the first line of each projected suffix
        behind = placed.select("row", (F.col("pos") - 1).alias("last"), F.col("id_a").alias("next_a"), F.col("id_b").alias("next_b"))
        longer = grown.join(behind, ["row", "last"]).select(
            "doc", "row", (F.col("last") + 1).alias("last"), F.col("id_a").alias("head_a"), F.col("id_b").alias("head_b"), "next_a", "next_b",
            *_name(F.col("id_a"), F.col("id_b"), F.col("next_a"), F.col("next_b")),
        )
        longer = cut_lineage(longer)
        if before is not None:
            discard(before)
        before = longer
        parts = ["head_a", "head_b", "next_a", "next_b"]
        counted = longer.select(*_ID, *parts, "doc").distinct().groupBy(*_ID, *parts).agg(F.count("*").alias("n_documents")).where(F.col("n_documents") >= support)
        heads = level.select(F.col("id_a").alias("head_a"), F.col("id_b").alias("head_b"), "site", F.col("lines").alias("head"))
        nexts = single.select(F.col("id_a").alias("next_a"), F.col("id_b").alias("next_b"), "line")
        level = counted.join(heads, ["head_a", "head_b"]).join(nexts, ["next_a", "next_b"])
        level = cut_lineage(level.select(*_ID, "site", F.concat("head", F.array("line")).alias("lines"), "n_documents"))
        if level.isEmpty():
            discard(placed, longer, level)
            break
        found = found.unionByName(level)
        grown = longer.select("doc", "row", "last", *_ID).join(level.select(*_ID), _ID, "left_semi")
    return found.select("site", "lines", F.size("lines").alias("n_lines"), "n_documents")


def without_repeated(documents: DataFrame, key: str, site: str, text: str, support: int = SUPPORT) -> DataFrame:
    """``(key, text_clean, n_removed)``: each text without the lines of frequent sequences.

    Every line of a frequent sequence is a frequent line itself, so the lines of level 1
    are all that is deleted. Texts without site stay as they are, null texts stay null; rows
    with a null key are left out. ``key`` must be unique.
    """
    rows = cut_lineage(documents.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(site).alias("site"), F.col(text).alias("text")))
    frequent = _frequent_lines(_lines(rows, "doc", "site", "text"), support, unique=True).select(*_ID, F.lit(True).alias("gone"))
    both = F.arrays_zip(F.split("text", "\n").alias("raw"), line_keys(F.col("text")).alias("line"))
    pieces = rows.where(F.col("site").isNotNull() & F.col("text").isNotNull()).select("doc", "site", F.posexplode(both).alias("pos", "z"))
    pieces = pieces.select("doc", "pos", F.col("z.raw").alias("raw"), *_name(F.col("site"), F.col("z.line")))
    marked = pieces.join(frequent, _ID, "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "raw"))))
    rebuilt = marked.groupBy("doc").agg(F.array_join(F.transform(kept, lambda x: x["raw"]), "\n").alias("clean"), F.count("gone").alias("n_removed"))
    joined = rows.select("doc", "text").join(rebuilt, "doc", "left")
    return joined.select(F.col("doc").alias(key), F.when(F.col("n_removed").isNull(), F.col("text")).otherwise(F.col("clean")).alias("text_clean"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"))
