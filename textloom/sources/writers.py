"""Writers, and the columns that files need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the exported table, old name to new.
TABLE_COLUMNS = {
    "url": "url",
    "filename": "id",
    "date": "date",
    "og:title": "og:title",
    "og:description": "og:description",
    "h1": "h1",
    "h2": "h2",
    "time_crawled": "time_crawled",
    "expert_annotator_1": "expert_annotator_1",
    "expert_annotator_2": "expert_annotator_2",
    "student_annotator_1": "student_annotator_1",
    "student_annotator_2": "student_annotator_2",
    "gold_label": "label",
    "Claude_0shot": "claude3.7_label",
    "GPT4o": "gpt4o_label",
}


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; an existing folder is an error unless asked for."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def copy_corpus(df: DataFrame, path: str, keys: Sequence[str] | None = None, existing: DataFrame | None = None, key: str = "id") -> None:
    """Append the rows that are not in ``existing``, with some of the columns."""
    rows = df.join(existing.select(key), key, "left_anti") if existing is not None else df
    (rows.select(*keys) if keys else rows).write.mode("append").json(path)


def with_padded_index(df: DataFrame, order: str, name: str = "name", prefix: str = "", file: str | None = None) -> DataFrame:
    """Rows with consecutive names: numbers from 1, padded to the digits of their count.

    Rows whose ``file`` holds ``deduped`` have no name. Numbers come from a range sort and the
    counts of its partitions, not from one task.
    """
    skipped = F.coalesce(F.contains(F.col(file), F.lit("deduped")), F.lit(False)) if file else F.lit(False)
    named = df.where(~skipped).repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    from ..session import cut_lineage

    named = cut_lineage(named)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    sizes = named.groupBy("__part").agg(F.count("*").alias("k"))
    # one row a partition
    before = F.coalesce(F.sum("k").over(Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"), F.sum("k").over(Window.partitionBy(F.lit(1))).alias("__all"))
    numbered = named.withColumn("__in", inside).join(F.broadcast(offsets), "__part")
    digits = F.length(F.col("__all").cast("string"))
    number = (F.col("__before") + F.col("__in")).cast("string")
    full = F.concat(F.lit(prefix), F.when(F.length(number) < digits, F.concat(F.repeat(F.lit("0"), digits - F.length(number)), number)).otherwise(number))
    out = numbered.withColumn(name, full).drop("__part", "__in", "__before", "__all")
    return out.unionByName(df.where(skipped).withColumn(name, F.lit(None).cast("string"))) if file else out


def table_rows(df: DataFrame, columns: dict[str, str] = TABLE_COLUMNS) -> DataFrame:
    """The columns of the exported table in order under their new names; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{old}`") if old in have else F.lit(None).cast("string")).alias(new) for old, new in columns.items()])


def write_table(df: DataFrame, path: str, sep: str = ",", append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").csv(path, header=True, sep=sep, quoteAll=False, escape='"')


def append_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of earlier runs and of a new one; columns of either."""
    return runs.unionByName(new, allowMissingColumns=True)


def write_wordlist(words: DataFrame, path: str, term: str = "term", order: str = "ord") -> None:
    """A term a line in order, words parted by blanks; an existing folder stays as it is."""
    lines = words.orderBy(order).select(F.array_join(term, " ").alias("value"))
    lines.coalesce(1).write.mode("ignore").text(path)


#: Folders that annotators sort sheets into.
ANNOTATION_FOLDERS = ["1_hauptthema", "2_nebenthema", "3_kein_thema", "4_unklar", "corpus_full"]


def make_annotation_folders(spark: SparkSession, path: str, names: Sequence[str] = ANNOTATION_FOLDERS) -> None:
    """Empty folders by label; a folder that is there already is an error."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    if system.exists(target):
        raise FileExistsError(path)
    for name in names:
        system.mkdirs(jvm.org.apache.hadoop.fs.Path(target, name))


def write_sheets(sheets: DataFrame, path: str, name: str, text: str) -> None:
    """Text sheets in folders by name; an existing folder stays as it is."""
    sheets.select(name, F.col(text).alias("value")).write.mode("ignore").partitionBy(name).text(path)
