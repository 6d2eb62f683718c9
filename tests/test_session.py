import os
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from textloom import session


def test_cut_lineage_keeps_rows_and_columns(spark):
    df = spark.range(5).select("id", F.lit(None).alias("none"), F.col("id").alias("ID x"), F.array(F.struct(F.lit(b"a").alias("b"))).alias("s"), (F.col("id") % 2).alias("id"))
    cut = session.cut_lineage(df)
    assert cut.columns == df.columns and cut.dtypes == df.dtypes
    assert sorted(map(str, cut.collect())) == sorted(map(str, df.collect()))
    assert session.cut_lineage(df.limit(0)).count() == 0


def test_written_tables_are_released(spark):
    cut = session.cut_lineage(spark.range(3))
    (path,) = {os.path.dirname(f.replace("file://", "").replace("file:", "")) for f in cut.inputFiles()}
    assert os.path.exists(path)
    session.release(spark)
    assert not os.path.exists(path)
    assert session.cut_lineage(spark.range(3)).count() == 3


def test_a_cluster_without_shared_folder_is_an_error():
    far = MagicMock()
    far.conf.get.return_value = None
    far.sparkContext.master = "spark://far:7077"
    far.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    with pytest.raises(ValueError):
        session.shared_folder(far)


def test_numbers_are_consecutive(spark):
    df = spark.createDataFrame([(f"k{n:03}", n) for n in range(300)], "k string, n int").repartition(7)
    assert all(r.number == r.n for r in session.numbered(df, "number", "k").collect())
    assert session.numbered(df.limit(0), "number", "k").count() == 0


def test_discarded_tables_are_removed_and_others_stay(spark):
    a, b = session.cut_lineage(spark.range(3)), session.cut_lineage(spark.range(4))
    (path,) = {os.path.dirname(f.replace("file://", "").replace("file:", "")) for f in a.inputFiles()}
    c = session.cut_lineage(a.join(b, "id"))
    session.discard(a, spark.range(2))
    assert not os.path.exists(path) and c.count() == 3 and b.count() == 4
