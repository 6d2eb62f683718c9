"""Post-editing of a corpus: lengths, paragraphs, languages and other conditions on texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def length_stats(df: DataFrame, text: str) -> DataFrame:
    """One row ``(n, mean, median, max, min)`` of the texts' characters; nulls are left out."""
    n = F.length(text)
    return df.agg(F.count(n).alias("n"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).alias("max"), F.min(n).alias("min"))


def length_histogram(df: DataFrame, length: Column, bins: int = 100) -> DataFrame:
    """``(bin, lo, n)``: equal bins from the least to the largest value; the last includes its end."""
    values = df.select(length.cast("double").alias("v")).where(F.col("v").isNotNull())
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)))
    counted = values.crossJoin(F.broadcast(ends)).groupBy(number.cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))  # one row of ends
    return counted.select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("lo"), "n")


def beyond(value: Column, threshold: float, direction: str) -> Column:
    """Whether a value lies strictly below or above a threshold; equal values and nulls do not."""
    if direction not in ("<", ">"):
        raise ValueError("direction is '<' or '>'")
    return F.coalesce(value < threshold if direction == "<" else value > threshold, F.lit(False))


def without_lengths(df: DataFrame, text: str, threshold: float, direction: str) -> DataFrame:
    return df.where(~beyond(F.length(text), threshold, direction))


def mean_paragraph_length(text: Column) -> Column:
    """Mean characters of the parts between blank lines."""
    parts = F.split(text, "\n\n")
    return F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p)) / F.size(parts)


def paragraph_lengths(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, par_no, n_chars)``."""
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n\n")).alias("par_no", "p")).select("doc_id", "par_no", F.length("p").alias("n_chars"))


def without_paragraph_lengths(df: DataFrame, text: str, threshold: float, direction: str) -> DataFrame:
    return df.where(~beyond(mean_paragraph_length(F.col(text)), threshold, direction))


def detected_languages(df: DataFrame, doc_id: str, text: str, common_words: DataFrame) -> DataFrame:
    """``(doc_id, language, n_words)``: the language with most frequent words in the text.

    ``common_words`` (``lang, word``) is a fixed list of a few hundred words. Texts without
    any are ``Unknown``; equal numbers are decided by the lesser code.
    """
    listed = common_words.select("lang", F.lower("word").alias("word")).distinct()
    words = df.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))
    hits = words.groupBy("doc_id", "word").agg(F.count("*").alias("k")).join(listed, "word").groupBy("doc_id", "lang").agg(F.sum("k").alias("k"))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("k").desc(), "lang"))).where(F.col("r") == 1)
    return df.select(F.col(doc_id).alias("doc_id")).join(ranked, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit("Unknown")).alias("language"), F.coalesce("k", F.lit(0)).alias("n_words"))


#: Words of a language that its model keeps, most frequent first.
MODEL_WORDS = 5000


def letter_words(text: Column) -> Column:
    """Lower-cased words of letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}]+"), F.lit(0))


def language_model(labelled: DataFrame, text: str, label: str, vocabulary: int = MODEL_WORDS) -> DataFrame:
    """``(word, language, logp)``: a naive Bayes model of words from texts with a language label.

    All labelled texts are counted; of each language the ``vocabulary`` most frequent words stay
    (ties: the lesser word), and every word has a probability in every language, one
    occurrence added. Rows with a null label are left out.
    """
    words = labelled.where(F.col(label).isNotNull()).select(F.col(label).alias("language"), F.explode(letter_words(F.col(text))).alias("word"))
    counts = cut_lineage(words.groupBy("language", "word").agg(F.count("*").alias("k")))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(F.col("k").desc(), "word"))).where(F.col("r") <= vocabulary)
    known = cut_lineage(ranked.select("word").distinct())
    # one row, and one row a language
    size = known.agg(F.count("*").alias("v"))
    totals = counts.join(known, "word", "left_semi").groupBy("language").agg(F.sum("k").alias("total")).crossJoin(F.broadcast(size))
    # words by languages: at most languages * vocabulary words
    cells = known.crossJoin(F.broadcast(totals)).join(counts, ["word", "language"], "left")
    return cells.select("word", "language", F.ln((F.coalesce("k", F.lit(0)) + 1) / (F.col("total") + F.col("v"))).alias("logp"))


def classified_languages(df: DataFrame, doc_id: str, text: str, model: DataFrame) -> DataFrame:
    """``(doc_id, language, n_words, margin)``: the most probable language of each text by a ``language_model``.

    ``n_words`` counts the words that the model knows and ``margin`` is the mean advantage a word
    over the second language (0 with one language). Texts without a known word are ``Unknown``;
    equal probabilities are decided by the lesser name.
    """
    # a bounded table: languages * vocabulary words at most
    by_word = F.broadcast(model.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("language", "logp"))).alias("m")))
    words = df.select(F.col(doc_id).alias("doc_id"), F.explode(letter_words(F.col(text))).alias("word"))
    known = words.groupBy("doc_id", "word").agg(F.count("*").alias("k")).join(by_word, "word")
    scores = known.select("doc_id", "k", F.explode("m").alias("m")).groupBy("doc_id", F.col("m.language").alias("language")).agg(F.sum(F.col("k") * F.col("m.logp")).alias("score"), F.sum("k").alias("n_words"))
    # a row a language
    order = Window.partitionBy("doc_id").orderBy(F.round("score", 6).desc(), "language")
    best = scores.withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where(F.col("r") == 1)
    margin = F.coalesce((F.col("score") - F.col("second")) / F.col("n_words"), F.lit(0.0))
    found = best.select("doc_id", "language", "n_words", margin.alias("margin"))
    return df.select(F.col(doc_id).alias("doc_id")).join(found, "doc_id", "left").select("doc_id", F.coalesce("language", F.lit("Unknown")).alias("language"), F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("margin", F.lit(0.0)).alias("margin"))


def with_languages(df: DataFrame, doc_id: str, detected: DataFrame, languages: Iterable[str], keep: bool = True) -> DataFrame:
    """Documents in one of the languages, or all others; joined by key."""
    chosen = detected.where(F.col("language").isin(list(languages))).select(F.col("doc_id").alias(doc_id))
    return df.join(chosen, doc_id, "left_semi" if keep else "left_anti")


def apply_removal(df: DataFrame, condition: Column, file: str | None = None) -> DataFrame:
    """Rows that satisfy a condition; names with ``deduped`` are never removed, null conditions remove."""
    holds = F.coalesce(condition, F.lit(False))
    return df.where(holds | F.coalesce(F.contains(F.col(file), F.lit("deduped")), F.lit(False))) if file else df.where(holds)


#: The agency's mark, the tier that is not free, addresses of further pages.
AGENCY_MARK = "© dpa-infocom"
LOCKED_TIER = "locked"
FURTHER_PAGE = "/seite-[0-9]+"


def not_agency(text: Column) -> Column:
    return ~F.coalesce(F.contains(text, F.lit(AGENCY_MARK)), F.lit(False))


def not_locked(tier: Column) -> Column:
    return F.coalesce(tier != LOCKED_TIER, F.lit(True))


def not_multipage(url: Column) -> Column:
    return ~F.coalesce(url.rlike(FURTHER_PAGE), F.lit(False))


def words_of(text: Column) -> Column:
    """Words (letters, digits, underscore) of a text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def lexicon(df: DataFrame, token: str, lemma: str) -> DataFrame:
    """``(word, lemma)``: the most frequent lemma of each token of parallel arrays, by position."""
    pairs = df.where(F.size(token) == F.size(lemma)).select(F.explode(F.arrays_zip(F.col(token).alias("t"), F.col(lemma).alias("l"))).alias("p"))
    counted = pairs.where(F.col("p.t").isNotNull() & F.col("p.l").isNotNull()).groupBy(F.col("p.t").alias("word"), F.col("p.l").alias("lemma")).agg(F.count("*").alias("k"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.col("k").desc(), "lemma")))
    return ranked.where(F.col("r") == 1).select("word", "lemma")


#: Words in most documents whose lemmas go to every task, so that no task gets all rows of one of them.
FREQUENT_WORDS = 1000


def lemmatized(df: DataFrame, doc_id: str, text: str, words: DataFrame) -> DataFrame:
    """``(doc_id, token, lemmas)``: the words of each text and their lemmas (themselves where unknown).

    A document meets the lexicon with each distinct word once; keys are unique.
    """
    tokens = cut_lineage(df.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("token")))
    each = tokens.select("doc_id", F.explode(F.array_distinct("token")).alias("word"))
    # at most FREQUENT_WORDS rows
    frequent = F.broadcast(each.groupBy("word").agg(F.count("*").alias("k")).orderBy(F.col("k").desc(), "word").limit(FREQUENT_WORDS).select("word"))
    head = F.broadcast(words.join(frequent, "word", "left_semi").select("word", "lemma"))
    common = each.join(frequent, "word", "left_semi").join(head, "word")
    others = each.join(frequent, "word", "left_anti").join(words.select("word", "lemma"), "word")
    found = common.unionByName(others).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("known"))
    joined = tokens.join(found, "doc_id", "left")
    lemma = F.transform("token", lambda w: F.coalesce(F.try_element_at(F.col("known"), w), w))
    return joined.select("doc_id", "token", lemma.alias("lemmas"))
