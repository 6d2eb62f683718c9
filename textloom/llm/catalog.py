"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, discard, latest_rows, table
from . import consensus, cooccurrence, frequency, language_id, main_content, mixing, packing, repeated_lines, shared_spans, structure, topics
from .sql import ORACLE
from .tokens import n_tokens

VOTERS = ["expert_annotator_1", "expert_annotator_2", "student_annotator_1", "student_annotator_2"]


def _latest_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    return latest_rows(table(spark, folder, "articles").select("id", "ingested_at", "lemmas"), "id", "ingested_at").select("lemmas")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    marked = frequency.term_marks(_latest_lemmas(spark, folder), "lemmas")
    return marked.where(F.col("mark").isNotNull()).select("term", "mark")


def p1_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_marks(_latest_lemmas(spark, folder), "lemmas").select("term", "occurrences", "records", "mark")


def p1_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = frequency.ngram_frequencies(_latest_lemmas(spark, folder), "lemmas", 2).where(F.size("ngram") > 0)
    return counted.select(F.array_join("ngram", " + ").alias("ngram"), F.size("ngram").alias("n"), "occurrences", "records")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence.frequent_pairs(cut_lineage(_latest_lemmas(spark, folder)), "lemmas").select("term_a", "term_b")


def p7_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cooccurrence.frequent_pairs(cut_lineage(_latest_lemmas(spark, folder)), "lemmas")
    return pairs.withColumn("lift", F.round("lift", 6))


def normal_label(column: str):
    """One of the three labels that a raw vote stands for, else null."""
    trimmed = F.lower(F.trim(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")))
    return (
        F.when(trimmed.startswith("1_"), F.lit("1_hauptthema"))
        .when(trimmed.startswith("2_"), F.lit("2_nebenthema"))
        .when(trimmed.startswith("3_"), F.lit("3_kein_thema"))
    )


def _votes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = latest_rows(table(spark, folder, "ratings").select("id", "ingested_at", "gold_label", *VOTERS), "id", "ingested_at")
    rows = rows.select("id", normal_label("gold_label").alias("gold"), *[normal_label(c).alias(c) for c in VOTERS])
    long = rows.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("annotator"), F.col(c).alias("label")) for c in VOTERS])).alias("v"))
    return rows, long.select(F.col("id").alias("item"), "v.annotator", "v.label").where(F.col("label").isNotNull())


def _agreed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest ratings, consensus and annotators; these annotators err to one side, which ``log_odds`` allows for."""
    rows, votes = _votes(spark, folder)
    return rows, *consensus.truth_discovery(votes, ordered=True, weights="log_odds")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, agreed, _ = _agreed(spark, folder)
    both = agreed.where(F.col("n_votes") >= 3).join(rows.select(F.col("id").alias("item"), "gold"), "item")
    return both.where(~F.col("gold").eqNullSafe(F.col("label"))).select(F.col("item").alias("id"), "label")


def p4_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return _agreed(spark, folder)[1].withColumnRenamed("item", "id")


def p4_annotators(spark: SparkSession, folder: str) -> DataFrame:
    return _agreed(spark, folder)[2].withColumns({"reliability": F.round("reliability", 6), "weight": F.round("weight", 1)})


def p4_bound_consensus(spark: SparkSession, folder: str) -> DataFrame:
    agreed, _ = consensus.truth_discovery(_votes(spark, folder)[1], ordered=True)
    return agreed.select(F.col("item").alias("id"), "label", "n_votes", F.round("agreement", 6).alias("agreement"))


def p4_bound_annotators(spark: SparkSession, folder: str) -> DataFrame:
    _, people = consensus.truth_discovery(_votes(spark, folder)[1], ordered=True)
    return people.withColumns({"reliability": F.round("reliability", 6), "weight": F.round("weight", 2)})


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", n_tokens(F.col("text")).alias("n_tokens"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(_sized(spark, folder), "doc_id", "n_tokens")
    return packed.where(F.col("n_parts") > 1).select(F.col("item").alias("doc_id")).distinct()


def p8_parts(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(_sized(spark, folder), "doc_id", "n_tokens")
    return packed.select(F.col("item").alias("doc_id"), "part", "n_parts", "start", "length")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_contents(packing.pack(_sized(spark, folder), "doc_id", "n_tokens"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents")
    rows = documents.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), "text")
    vocabulary = topics.fit_vocabulary(documents, "doc_id", "text")
    found = language_id.identify_languages(topics.with_vectors(rows, "text", vocabulary), "doc_id", "text", _dictionaries(spark, folder), carry=("source", "n_tokens", "vector"))
    main = cut_lineage(found.where(F.col("seg_no") == -1).select("doc_id", "source", "n_tokens", F.col("lang").alias("language"), "vector"))
    centres = topics.fit_centres(main, "doc_id", "vector", len(vocabulary.idf))
    named = cut_lineage(topics.with_nearest(main, "vector", centres).drop("vector"))
    discard(main)
    return mixing.mix(named, table(spark, folder, "mix_targets"), "doc_id", "source", "n_tokens", "language", "topic")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1].where("short").select("source")


def p9_targets(spark: SparkSession, folder: str) -> DataFrame:
    report = _mixed(spark, folder)[1].withColumn("target_tokens", F.round("target_tokens", 3))
    return report.select("source", "target_share", "max_repeats", "total_tokens", "available_tokens", "target_tokens", "short")


def p9_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def _site_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_rows(table(spark, folder, "articles").select("id", "ingested_at", "url", "text_deduped"), "id", "ingested_at")
    return rows.select("id", repeated_lines.site_of(F.col("url")).alias("site"), "text_deduped")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_lines.frequent_sequences(_site_texts(spark, folder), "id", "site", "text_deduped", unique=True)
    return found.where(F.col("n_lines") == 1).select("site", F.col("lines")[0].alias("line_key"))


def p6_sequences(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_lines.frequent_sequences(_site_texts(spark, folder), "id", "site", "text_deduped", unique=True)
    return found.withColumn("lines", F.array_join("lines", "\n"))


def p6_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = repeated_lines.without_repeated(_site_texts(spark, folder), "id", "site", "text_deduped")
    return cleaned.select("id", "text_clean", "n_removed")


def _dictionaries(spark: SparkSession, folder: str) -> dict[str, bytes]:
    return language_id.fit_dictionaries(table(spark, folder, "documents"), "doc_id", "text", "lang", table(spark, folder, "common_words"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.wrong_labels(table(spark, folder, "documents"), "doc_id", "text", "lang", _dictionaries(spark, folder))


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify_languages(table(spark, folder, "documents"), "doc_id", "text", _dictionaries(spark, folder))


def p5_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return structure.text_structure(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words"))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = p5_statistics(spark, folder).withColumn("mean_word_length", F.round("mean_word_length", 6))
    return counted.select("doc_id", "n_chars", "n_words", "n_lines", "mean_word_length")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    kinds = p5_statistics(spark, folder)
    return kinds.where((F.col("kind") != "prose") & (F.col("n_chars") >= structure.CASE_CHARS)).select("doc_id", "kind")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "raw_pages").select("page_id", "url", "source", "html_content")
    texts = latest_rows(table(spark, folder, "articles").select("id", "page_id", "ingested_at", "text"), "id", "ingested_at")
    site = F.coalesce(repeated_lines.site_of(F.col("url")), F.col("source"))
    address = F.coalesce(F.regexp_extract("url", r"^[^:/?#]+://[^/?#]+([^?#]*)", 1), F.col("page_id").cast("string"))
    return main_content.article_content(pages, texts, "page_id", site, address, "html_content", "text")


def _sharing(spark: SparkSession, folder: str) -> shared_spans.Candidates:
    return shared_spans.candidates(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = shared_spans.sharing_pairs(_sharing(spark, folder))
    return pairs.select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.class_table(table(spark, folder, "documents"), _sharing(spark, folder), "doc_id")


def p10_spans(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.span_table(_sharing(spark, folder))


def p10_shared_parts(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_parts(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {
    "p10_found": p10_found,
    "p10_classes": p10_classes,
    "p10_spans": p10_spans,
    "p10_shared_parts": p10_shared_parts,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_statistics": p5_statistics,
    "p5_counts": p5_counts,
    "p2_found": p2_found,
    "p2_languages": p2_languages,
    "p6_found": p6_found,
    "p6_sequences": p6_sequences,
    "p6_cleaned": p6_cleaned,
    "p8_found": p8_found,
    "p8_parts": p8_parts,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_targets": p9_targets,
    "p9_sample": p9_sample,
    "p9_report": p9_report,
    "p1_found": p1_found,
    "p1_term_counts": p1_term_counts,
    "p1_pair_counts": p1_pair_counts,
    "p4_found": p4_found,
    "p4_consensus": p4_consensus,
    "p4_annotators": p4_annotators,
    "p4_bound_consensus": p4_bound_consensus,
    "p4_bound_annotators": p4_bound_annotators,
    "p7_found": p7_found,
    "p7_pairs": p7_pairs,
}
