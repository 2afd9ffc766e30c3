"""Tables that steps hand to each other: Parquet in the folder that all executors share, so a lost executor costs a stage and a plan stays short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="frostline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a URI."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the application ends."""
    path = f"{shared_dir(spark)}/frostline/{name}-{uuid.uuid4().hex}"
    store, there = file_system(spark, path)
    store.deleteOnExit(there)
    return path


def remove(spark: SparkSession, path: str) -> None:
    store, there = file_system(spark, path)
    store.delete(there, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[str], name: str = "pos") -> tuple[DataFrame, int]:
    """(df with each row's place in ``order`` from 0, number of rows): a sort in ranges, to which the sizes of earlier ranges are added.

    No task sees more than a range; the driver gets one size a range.  Rows that tie take places in any order.
    """
    cut = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    cut = table(cut, "ranked")
    sizes = sorted(cut.groupBy("_range").count().collect())
    before, n = [], 0
    for part, count in sizes:
        before.append((part, n))
        n += count
    if not n:
        return cut.drop("_range").withColumn(name, F.lit(0).cast("long")), 0
    starts = df.sparkSession.createDataFrame(before, "_range int, _before long")
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return cut.join(F.broadcast(starts), "_range").withColumn(name, (local + F.col("_before")).cast("long")).drop("_range", "_before"), n
