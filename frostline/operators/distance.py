"""Distance matrices: made from vectors, or read as int16 rows; long form (i, j, d) for SQL operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import blocks

#: A stored cell times this is a distance in [-1, 1].
UNIT = 1.0 / 32767.0


def from_vectors(vectors: DataFrame, side: int | None = None) -> DataFrame:
    """(i, j, d) for unit vectors (idx, vector) of any ids: d = (1 - cosine) / 2 as int16, made by blocks of ``side`` rows and columns."""
    return blocks.distance_cells(vectors, side)


def read_matrix(spark: SparkSession, path: str, n: int, big_endian: bool = False, repetitions: int = 1) -> DataFrame:
    """Rows (i, d array<short>) of a binary row-major int16 file, or folder of part files, with n columns; repetitions tile the columns.

    Records are cut by Spark, so a file of any size is read in splits.
    """
    kind = np.dtype(">i2" if big_endian else "<i2")
    # part files of a folder follow each other by name
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().toString() for x in store.listStatus(there) if not x.getPath().getName().startswith(("_", "."))) if store.getFileStatus(there).isDirectory() else [path]
    records = spark.sparkContext.union([spark.sparkContext.binaryRecords(x, 2 * n) for x in names]).zipWithIndex().map(lambda r: (r[1], bytes(r[0])))
    raw = spark.createDataFrame(records, "i long, payload binary")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.concatenate([np.tile(np.frombuffer(x.as_buffer(), kind), repetitions) for x in b.column("payload")] or [np.zeros(0, np.int16)]).astype(np.int16)
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * n * repetitions
            yield pa.RecordBatch.from_arrays([b.column("i").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells))], names=["i", "d"])

    return raw.mapInArrow(decode, "i int, d array<short>")


def to_long(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.posexplode("d").alias("j", "d"))


def to_rows(cells: DataFrame) -> DataFrame:
    """Row form of (i, j, d); a row is one record, sorted by column."""
    return cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "d"))), lambda x: x["d"]).alias("d"))


def encode_rows(rows: DataFrame, big_endian: bool = False) -> DataFrame:
    """(i, payload): the bytes of each row, ready to be written in order of i."""
    kind = ">i2" if big_endian else "<i2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array([np.asarray(x, dtype=kind).tobytes() for x in b.column("d").to_pylist()], pa.binary())], names=["i", "payload"])

    return rows.mapInArrow(run, "i int, payload binary")


def off_diagonal(cells: DataFrame) -> DataFrame:
    return cells.where("i <> j")


def temperature(cells: DataFrame) -> DataFrame:
    """Initial temperature (twice the mean distance) and the diagnostics beside it; integer sums, so exact in any order."""
    return temperature_of(off_diagonal(cells).select(F.lit(1).cast("long").alias("n"), F.col("d").cast("long").alias("s"), (F.col("d").cast("long") * F.col("d").cast("long")).alias("q")))


def temperature_of(moments: DataFrame) -> DataFrame:
    """The same from (n, s, q) of any parts of the cells off the diagonal; sums of squares pass 64 bits, so they are decimals."""
    s = moments.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("q").cast("decimal(20,0)")).alias("q"))
    mean = F.col("s").cast("double") / F.col("n") / 32767.0
    square = F.col("q").cast("double") / F.col("n") / (32767.0 * 32767.0)
    out = s.select("n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("std"))
    dim = 2 * F.col("mean") * F.col("mean") / (F.col("std") * F.col("std"))
    return out.select("n", "mean", "std", dim.alias("dim"), F.sqrt(F.col("mean") / dim).alias("sigma"), (2 * F.col("mean")).alias("tinit"))


def asymmetric(cells: DataFrame) -> DataFrame:
    """Count of pairs whose two cells differ; the smaller index leads, so one shuffle on the pair suffices."""
    pair = cells.where("i <> j").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return pair.agg(F.count_if(F.col("lo") != F.col("hi")).alias("bad_pairs"))


def row_means(cells: DataFrame) -> DataFrame:
    """B with one cluster: (i, b), the diagonal included."""
    return cells.groupBy("i").agg((F.sum(F.col("d").cast("long")).cast("double") / F.count(F.lit(1)) / 32767.0).alias("b"))


def vector_means(vectors: DataFrame) -> DataFrame:
    """The same for the distances of vectors(idx, vector), from the sums of blocks that are not kept."""
    return blocks.row_sums(vectors).select(F.col("idx").alias("i"), (F.col("s").cast("double") / F.col("n") / 32767.0).alias("b"))
