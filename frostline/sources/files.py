"""Single small files and binary matrices in any store that Spark reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def write_text(spark: SparkSession, lines: list[str], path: str, mode: str = "overwrite") -> None:
    """A few driver-side lines (logs, settings, timings) as one part file of a folder."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode(mode).text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): lines by their place in the file, counted split by split."""
    rows = spark.sparkContext.textFile(path).zipWithIndex().map(lambda r: (r[1], r[0]))
    return spark.createDataFrame(rows, "pos long, value string")


def write_matrix(rows: DataFrame, path: str, big_endian: bool = False, partitions: int | None = None) -> DataFrame:
    """Row form (i, d array<short>) as binary part files whose names follow the rows' order, so read together they are the matrix.

    Each range of rows is streamed by its task under a temporary name and renamed when whole; returns (file, first, rows, bytes) of the parts.
    """
    from pyarrow import fs

    kind = ">i2" if big_endian else "<i2"
    count = partitions or rows.sparkSession.sparkContext.defaultParallelism
    out = path if "://" in path else f"file://{path}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.bin"
        temporary, first, n, size = f"{root}/_{name}.{uuid.uuid4().hex}", None, 0, 0
        with store.open_output_stream(temporary, compression=None) as stream:
            for b in batches:
                data = b.column("d").flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
                stream.write(data)
                if b.num_rows:
                    first = b.column("i")[0].as_py() if first is None else first
                n, size = n + b.num_rows, size + len(data)
        if n:
            store.move(temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "first": [first], "rows": [n], "bytes": [size]}, pa.schema([("file", pa.string()), ("first", pa.int32()), ("rows", pa.int64()), ("bytes", pa.int64())]))
        else:
            store.delete_file(temporary)

    ordered = rows.select("i", "d").repartitionByRange(count, "i").sortWithinPartitions("i")
    done = ordered.mapInArrow(write, "file string, first int, rows long, bytes long").collect()
    return rows.sparkSession.createDataFrame(done, "file string, first int, rows long, bytes long")
