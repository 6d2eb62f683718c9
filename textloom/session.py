"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StringType, StructField, StructType


def local_session(app: str = "textloom", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which executors share.

    Only a local session without the setting gets a temporary folder of its own, which is
    removed when Python ends; on a cluster the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is removed by ``release``, or when the driver's JVM ends."""
    sc = spark.sparkContext
    folder = f"{shared_folder(spark).rstrip('/')}/textloom-{sc.applicationId}"
    written = _written.get(sc.applicationId)
    if written is None:
        written = _written[sc.applicationId] = []
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = target.getFileSystem(sc._jsc.hadoopConfiguration())
        system.mkdirs(target)
        system.deleteOnExit(target)
    path = f"{folder}/{uuid.uuid4().hex}"
    written.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder of the session and read it from there.

    The table is compressed, columns that a reader leaves out are not read, and its size is
    known to the plans that read it.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    names = [f"c{k}" for k in range(len(df.columns))]
    # columns without a type cannot be written; they hold nothing but nulls
    bare = [isinstance(f.dataType, NullType) for f in df.schema]
    schema = StructType([StructField(n, StringType() if b else f.dataType, True) for n, f, b in zip(names, df.schema, bare)])
    plain = df.toDF(*names)
    plain.select(*[F.col(n).cast("string").alias(n) if b else n for n, b in zip(names, bare)]).write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if b else F.col(n).alias(c) for n, c, b in zip(names, df.columns, bare)])


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut_lineage`` wrote and nothing reads any more.

    What was written from them stays, so a lost executor does not need them.
    """
    for df in tables:
        spark = df.sparkSession
        written = _written.get(spark.sparkContext.applicationId, [])
        folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
        for path in [p for p in written if p.rsplit("/", 1)[-1] in folders]:
            written.remove(path)
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Remove the tables that ``cut_lineage`` wrote; results not yet read are lost."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def latest_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of several rows with one ``key`` keep the latest by the columns ``order``.

    Rows whose key is null are dropped. Rows that tie in every order column are
    told apart by a hash of the whole row, so the choice does not depend on the
    partitioning; full copies leave one row.
    """
    columns = df.columns
    rank = "__latest_rank"
    by: list[Column] = [F.col(c).desc_nulls_last() for c in order]
    by.append(F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    window = Window.partitionBy(key).orderBy(*by)
    return (
        df.where(F.col(key).isNotNull())
        .withColumn(rank, F.row_number().over(window))
        .where(F.col(rank) == 1)
        .drop(rank)
    )


def numbered(df: DataFrame, number: str, *order: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 in an order that no two rows share.

    Numbers come from a range sort and the counts of its partitions, not from one task; the
    sorted rows are written, so a repeated task cannot number them otherwise.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # one row a partition
    before = F.sum("k").over(Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy("__part").agg(F.count("*").alias("k")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = parts.withColumn("__in", inside).join(F.broadcast(offsets), "__part")
    return placed.withColumn(number, (F.col("__before") + F.col("__in") - 1).cast("long")).drop("__part", "__in", "__before")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
