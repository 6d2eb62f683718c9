"""Incremental cleaning: each run takes the page files that came since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import SiteProfile, clean_pages


def clean_new_pages(spark: SparkSession, pages: str, schema: str, out: str, checkpoint: str, profile: SiteProfile, url: str = "url", page: str = "html_content") -> StreamingQuery:
    """Read the parquet files of a folder as a stream and append the articles to ``out``.

    The checkpoint folder remembers which files are done, so the query ends when all that is
    there is cleaned and a later run goes on from there, after a failure too.
    """
    source = spark.readStream.schema(schema).parquet(pages)

    def write(batch: DataFrame, number: int) -> None:
        articles = clean_pages(batch, profile, url, page)
        articles.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
