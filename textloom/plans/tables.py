"""The corpus of the test tables, as the queries use it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import corpus
from ..operators.rating import normal_label
from ..session import latest_rows, table

#: Names of sources by marks in the url.
SOURCES = {"tagesecho.example": "tagesecho", "wissensblatt.example": "wissensblatt", "forumtechnik.example": "forumtechnik"}
RATERS = ["expert_annotator_1", "expert_annotator_2", "student_annotator_1", "student_annotator_2"]


def articles(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The latest row of each article, with the columns asked for."""
    return latest_rows(table(spark, folder, "articles").select(*dict.fromkeys(["id", "ingested_at", *columns])), "id", "ingested_at")


def ratings(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest_rows(table(spark, folder, "ratings").select(*dict.fromkeys(["id", "ingested_at", *columns])), "id", "ingested_at")


def pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest_rows(table(spark, folder, "raw_pages").select(*dict.fromkeys(["page_id", "ingested_at", *columns])), "page_id", "ingested_at")


def words(spark: SparkSession, folder: str, *columns: str, keep="default") -> DataFrame:
    """``(doc_id, tokens, *columns)`` of the articles' lemmas, without blanks around."""
    rows = articles(spark, folder, "lemmas", *columns)
    rows = rows.withColumn("lemmas", F.transform("lemmas", lambda w: F.regexp_replace(w, "^[ \u00a0\t]+|[ \u00a0\t]+$", "")))
    return corpus(rows, "id", "lemmas", *columns) if keep == "default" else corpus(rows, "id", "lemmas", *columns, keep=keep)


def labelled_words(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The corpus with the normal gold label of each article (null where none)."""
    gold = ratings(spark, folder, "gold_label").select(F.col("id").alias("doc_id"), normal_label(F.col("gold_label")).alias("label"))
    return words(spark, folder, *columns).join(gold, "doc_id", "left")


def core_terms(spark: SparkSession, folder: str) -> list[tuple[str, ...]]:
    """The wordlist (a few terms) in its order."""
    return [tuple(r.term) for r in table(spark, folder, "wordlist").orderBy("ord").select("term").collect()]


def term_weights(spark: SparkSession, folder: str) -> dict[tuple[str, ...], float]:
    return {tuple(r.term): r.weight for r in table(spark, folder, "wordlist").orderBy("ord").collect()}


def stopwords(spark: SparkSession, folder: str, *langs: str) -> list[str]:
    """Frequent words (a fixed list) of the languages."""
    return sorted(r.word for r in table(spark, folder, "common_words").where(F.col("lang").isin(list(langs or ("de", "en")))).select("word").distinct().collect())
