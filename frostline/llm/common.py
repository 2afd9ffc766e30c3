"""Helpers that every operator of this folder shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes in one Arrow batch sent to Python, so a worker's memory does not follow the row count.
ARROW_BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Session settings that the operators rely on (all can be changed afterwards).

    Arrow batches are bounded in bytes, and shuffle files of a finished action are removed, because the
    operators hand results between actions through tables in the shared folder, not through shuffles.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only a local master may go without; it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="frostline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a URI, so any store that Spark reads will do."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    store, there = _hadoop(spark, path)
    return store.exists(there)


def table(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    The files are deleted when the application ends, as the frames that operators return may still read them before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/frostline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    store, there = _hadoop(spark, path)
    store.deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than this share of all rows is heavy; there are at most so many of them.
HEAVY_KEYS = 5_000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """rows LEFT JOIN classes on ``keys``, unique in classes, whose column ``copies`` counts the rows of a key.

    Keys with over 1 / ``HEAVY_KEYS`` of the ``total`` rows are thus at most ``HEAVY_KEYS``: they are broadcast, so no key's rows meet in one task.
    """
    heavy = F.col(copies) * HEAVY_KEYS > total
    large = table(classes.where(heavy), "heavy-keys")
    if large.limit(1).count() == 0:
        return rows.join(classes, keys, "left")
    hot = rows.join(F.broadcast(large), keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(classes.where(~heavy), keys, "left")
    return hot.unionByName(rest)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
