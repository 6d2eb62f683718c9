"""Readers of page, article, wordlist and result files."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import chained_source

PAGE = "url string, html_content string, time_crawled string"
ARTICLE = (
    "url string, h1 string, h2 string, keywords array<string>, time_crawled string, text_html string, text string, "
    "text_deduped string, lemmas array<string>, token array<string>, gold_label string, meta map<string,string>"
)
BATCH_OUTPUT = (
    "custom_id string, result struct<type:string, message:struct<content:array<struct<input:struct<topic_ai:boolean>>>, "
    "usage:struct<input_tokens:bigint, output_tokens:bigint>>>"
)


def read_pages(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Crawled pages, one JSON file each, with ``file``."""
    found = spark.read.schema(PAGE).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json").json(path, multiLine=True)
    return found.withColumn("file", F.input_file_name())


def read_articles(spark: SparkSession, path: str, sources: dict[str, str] | None = None) -> DataFrame:
    """Articles, one JSON file each; ``url`` and ``lemmas`` are needed, files without are errors.

    Adds ``file`` (the name) and ``source`` by marks in the url.
    """
    rows = spark.read.schema(ARTICLE).option("pathGlobFilter", "*.json").json(path, multiLine=True)
    checked = rows.withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    for name in ("url", "lemmas"):
        checked = checked.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.concat(F.lit(f"no {name} in "), F.col("file")))).otherwise(F.col(name)))
    return checked.withColumn("source", chained_source(F.col("url"), sources or {}))


def reference_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in an order that a hash of key and seed fixes; all rows if ``n`` is not positive.

    More rows than there are is an error.
    """
    if n <= 0:
        return df
    if df.limit(n).count() < n:
        raise ValueError(f"the sample of {n} is larger than the population")
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, term array<string>)``: a term a line, a plain word or a tuple literal of words."""

    def parse(line: str) -> list[str]:
        line = line.strip()
        if line.startswith(("(", "[", '"', "'")):
            value = ast.literal_eval(line)
            return [value] if isinstance(value, str) else [str(x) for x in value]
        return [line]

    # a wordlist is a query: some dozens of lines
    contents = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    terms = [parse(x) for content in contents for x in content.splitlines() if x.strip()]
    return spark.createDataFrame(list(enumerate(terms)), "ord int, term array<string>")


def read_patterns(spark: SparkSession, path: str) -> str:
    """The lines of a file as alternatives of one pattern."""
    return "|".join(x for r in spark.read.text(path, wholetext=True).collect() for x in r.value.splitlines() if x.strip())


def read_batch_output(spark: SparkSession, path: str) -> DataFrame:
    """``(custom_id, result_type, topic_ai, input_tokens, output_tokens)`` of JSON lines."""
    rows = spark.read.schema(BATCH_OUTPUT).json(path)
    return rows.select(
        "custom_id",
        F.col("result.type").alias("result_type"),
        F.col("result.message.content")[0]["input"]["topic_ai"].alias("topic_ai"),
        F.col("result.message.usage.input_tokens").alias("input_tokens"),
        F.col("result.message.usage.output_tokens").alias("output_tokens"),
    )


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV table with header, all columns strings; quoted fields may span lines."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, length)`` of the files of a folder, recursively; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def file_totals(found: DataFrame) -> DataFrame:
    """One row ``(n_files, n_bytes, size)``."""
    from ..functions.words import formatted_size

    sums = found.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
    return sums.withColumn("size", formatted_size(F.col("n_bytes")))
