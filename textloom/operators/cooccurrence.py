"""Co-occurrence counts in windows or units, margins, and collocations of a word.

Counts are a sparse edge table ``(w, o, cnt)``; smoothing is added in the formulas and never
fills the table. A unit is a stretch of a document between separator tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.association import NEVER, log_dice, minimum_sensitivity, pmi
from ..session import cut_lineage


def units(docs: DataFrame, separator: str | None = None) -> DataFrame:
    """``(doc_id, unit_no, tokens)``; without separator a document is one unit. No empty units."""
    if separator is None:
        return docs.where(F.size("tokens") > 0).select("doc_id", F.lit(0).alias("unit_no"), "tokens")
    # cut at the separator's places, found once per document
    n = F.size("tokens")
    places = F.transform(
        F.filter(F.transform("tokens", lambda w, i: F.when(w == separator, i)), lambda i: i.isNotNull()),
        lambda i: i.cast("int"),
    )
    edges = F.concat(F.array(F.lit(-1)), places, F.array(n))
    spans = F.transform(
        F.slice(edges, F.lit(1), F.size(edges) - 1),
        lambda lo, k: F.struct(lo.alias("lo"), F.element_at(edges, k + 2).alias("hi")),
    )
    cut = docs.select("doc_id", "tokens", spans.alias("spans"))
    pieces = cut.select(
        "doc_id",
        F.posexplode(
            F.transform("spans", lambda s: F.slice("tokens", s["lo"] + 2, F.greatest(s["hi"] - s["lo"] - 1, F.lit(0))))
        ).alias("unit_no", "tokens"),
    )
    return pieces.where(F.size("tokens") > 0)


def window_counts(docs: DataFrame, window: int, separator: str | None = None, count_duplicates: bool = True) -> DataFrame:
    """Edges of words within ``window`` positions inside a unit.

    Each position counts every distinct word around it once; a word meets itself only at
    another position. Without ``count_duplicates`` only a word's first position in a unit counts.
    """
    if window < 1:
        return unit_counts(docs, separator, count_duplicates)
    each = units(docs, separator)
    tokens = F.col("tokens")

    def around(w: Column, i: Column) -> Column:
        left = F.slice(tokens, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window)))
        right = F.slice(tokens, i + 2, F.lit(window))
        return F.struct(w.alias("w"), F.array_distinct(F.concat(left, right)).alias("near"), (F.array_position(tokens, w) == i + 1).alias("first"))

    seen = each.select(F.explode(F.transform(tokens, around)).alias("p"))
    if not count_duplicates:
        seen = seen.where("p.first")
    return seen.select("p.w", F.explode("p.near").alias("o")).groupBy("w", "o").agg(F.count("*").alias("cnt"))


def unit_words(docs: DataFrame, separator: str | None = None, count_duplicates: bool = True) -> DataFrame:
    """``(words array<struct<w, tf>>)``: the distinct words of each unit with their occurrences (1 without ``count_duplicates``).

    Words are counted by the places where they begin in the sorted unit, so a unit of any size
    takes a sort and no comparison of all with all.
    """
    each = units(docs, separator).select(F.sort_array("tokens").alias("s"))
    begins = F.filter(F.transform("s", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get("s", x["i"] - 1) != x["w"]))
    placed = each.select("s", begins.alias("b"))
    ends = F.concat(F.slice(F.transform("b", lambda x: x["i"]), F.lit(2), F.size("b")), F.array(F.size("s")))
    counted = F.zip_with("b", ends, lambda x, e: F.struct(x["w"].alias("w"), ((e - x["i"]) if count_duplicates else F.lit(1)).cast("long").alias("tf")))
    return placed.select(counted.alias("words"))


def unit_counts(docs: DataFrame, separator: str | None = None, count_duplicates: bool = True) -> DataFrame:
    """Edges of different words of one unit: for each occurrence of ``w`` each other distinct word once."""
    # written, for the words would be found anew for every word that is opened
    each = cut_lineage(unit_words(docs, separator, count_duplicates))
    opened = each.select(F.explode("words").alias("p"), F.col("words.w").alias("others"))
    edges = opened.select("p.w", "p.tf", F.explode("others").alias("o")).where(F.col("w") != F.col("o"))
    return edges.groupBy("w", "o").agg(F.sum("tf").alias("cnt"))


def unit_node_counts(docs: DataFrame, node: str, separator: str | None = None, count_duplicates: bool = True) -> DataFrame:
    """What ``collocations`` of one node needs of the unit-wide edges, without the pairs of other words.

    ``(term, total, cnt, back)`` of each word with a co-occurrence: its margin, which is the sum
    over units of its occurrences times the other distinct words, and the edges from and to the
    node (null where there are none), which only units that hold the node give.
    """
    each = cut_lineage(unit_words(docs, separator, count_duplicates))
    mine = F.element_at(F.filter("words", lambda x: x["w"] == node), 1)["tf"]
    held = each.select("words", (F.size("words") - 1).cast("long").alias("others"), F.when(F.exists("words", lambda x: x["w"] == node), mine).alias("tf_node"))
    opened = held.where("others > 0").select(F.explode("words").alias("p"), "others", "tf_node").where(F.col("p.w").isNotNull())
    apart = (F.col("p.w") != node) & F.col("tf_node").isNotNull()
    return opened.groupBy(F.col("p.w").alias("term")).agg(
        F.sum(F.col("p.tf") * F.col("others")).alias("total"),
        F.sum(F.when(apart, F.col("tf_node"))).alias("cnt"),
        F.sum(F.when(apart, F.col("p.tf"))).alias("back"),
    )


def margins(edges: DataFrame) -> DataFrame:
    """``(w, total)`` of every word with a co-occurrence."""
    return edges.groupBy("w").agg(F.sum("cnt").alias("total"))


def totals(edges: DataFrame) -> DataFrame:
    """One row ``(vocabulary, grand)``."""
    return margins(edges).agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("total"), F.lit(0)).alias("grand"))


def without_stopwords(edges: DataFrame, stopwords: Iterable[str], recompute_margins: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges without rows and columns of stop words, and their margins.

    Margins keep what the dropped columns gave unless ``recompute_margins``.
    """
    gone = sorted({w.lower() for w in stopwords})
    kept = edges.where(~F.lower("w").isin(gone) & ~F.lower("o").isin(gone))
    left = margins(kept) if recompute_margins else margins(edges).where(~F.lower("w").isin(gone))
    return kept, left


def scored_edges(edges: DataFrame, smoothing: float = 0.0, table_smoothing: float = 0.0, exponent: float = 1.0, marginal: DataFrame | None = None) -> DataFrame:
    """Edges with margins and all measures: ``pmi, npmi, log_dice, min_sens``.

    ``table_smoothing`` adds to every cell of the word-by-word table before margins are taken,
    ``smoothing`` in the measures; both are computed, no cell is filled in.
    """
    sums = marginal if marginal is not None else margins(edges)
    whole = sums.agg(F.count("*").alias("v"), F.sum("total").alias("grand"))
    reverse = edges.select(F.col("w").alias("o"), F.col("o").alias("w"), F.col("cnt").alias("back"))
    joined = (
        edges.join(sums.select("w", F.col("total").alias("w_total")), "w")
        .join(sums.select(F.col("w").alias("o"), F.col("total").alias("o_total")), "o")
        .join(reverse, ["w", "o"], "left")
        .crossJoin(F.broadcast(whole))  # one row
    )
    t, v = F.lit(table_smoothing), F.col("v")
    f, back = F.col("cnt") + t, F.coalesce("back", F.lit(0)) + t
    f1, f2 = F.col("w_total") + t * v, F.col("o_total") + t * v
    n = F.col("grand") + t * v * v
    return joined.select(
        "w",
        "o",
        "cnt",
        "w_total",
        "o_total",
        pmi(f, f1, f2, n, v, smoothing, exponent).alias("pmi"),
        pmi(f, f1, f2, n, v, smoothing, exponent, normalize=True).alias("npmi"),
        log_dice(f, f1, f2, v, smoothing).alias("log_dice"),
        minimum_sensitivity(f, back, f1, f2, v, smoothing).alias("min_sens"),
    )


MEASURES = ["pmi", "npmi", "log_dice", "min_sens"]


def collocations(edges: DataFrame, node: str, measure: str | Callable[..., Column] = "pmi", min_count: int = 1, smoothing: float = 0.0) -> DataFrame:
    """``(term, stat)`` of the words that occur with ``node``.

    With ``min_count`` 0 every word of the vocabulary is listed. A callable measure gets the
    columns ``joint, left, right, total, vocabulary, smoothing``. Minus infinity for words that
    never occur with the node without smoothing. A node without co-occurrences gives no rows.
    """
    if isinstance(measure, str) and measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known are {MEASURES}")
    sums = margins(edges)
    mine = edges.where(F.col("w") == node).select(F.col("o").alias("term"), "cnt")
    back = edges.where(F.col("o") == node).select(F.col("w").alias("term"), F.col("cnt").alias("back"))
    terms = sums.select(F.col("w").alias("term"), "total").join(mine, "term", "left").join(back, "term", "left")
    return node_collocations(terms, node, measure, min_count, smoothing)


def node_collocations(terms: DataFrame, node: str, measure: str | Callable[..., Column] = "pmi", min_count: int = 1, smoothing: float = 0.0) -> DataFrame:
    """The same from a table ``(term, total, cnt, back)`` as ``unit_node_counts`` makes it."""
    if isinstance(measure, str) and measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known are {MEASURES}")
    # the node's margin and the totals are one row
    whole = terms.agg(F.count("*").alias("v"), F.sum("total").alias("grand"), F.max(F.when(F.col("term") == node, F.col("total"))).alias("left"))
    listed = terms if min_count <= 0 else terms.where(F.col("cnt").isNotNull())
    found = listed.withColumnRenamed("total", "right").crossJoin(F.broadcast(whole)).where(F.col("left").isNotNull())
    f, r = F.coalesce("cnt", F.lit(0)), F.coalesce("back", F.lit(0))
    f1, f2, n, v = F.col("left"), F.col("right"), F.col("grand"), F.col("v")
    if callable(measure):
        stat = measure(f, f1, f2, n, v, smoothing)
    elif measure in ("pmi", "npmi"):
        stat = pmi(f, f1, f2, n, v, smoothing, normalize=measure == "npmi")
    elif measure == "log_dice":
        stat = log_dice(f, f1, f2, v, smoothing)
    else:
        stat = minimum_sensitivity(f, r, f1, f2, v, smoothing)
    return found.where(f >= min_count).select("term", stat.alias("stat"))


def collocation_query(edges: DataFrame, doc_freq: DataFrame, node: str, measure: str = "npmi", smoothing: float = 0.0001, min_docs: int = 5, top: int = 50) -> DataFrame:
    """Best collocates with positive measure and enough documents, ties at the end included."""
    from .wordlists import top_with_ties

    scored = collocations(edges, node, measure, 1, smoothing).where((F.col("stat") > 0) & (F.col("stat") != F.lit(NEVER)))
    known = scored.join(doc_freq.select("term", "doc_freq"), "term").where(F.col("doc_freq") >= min_docs)
    return top_with_ties(known, "stat", top)
