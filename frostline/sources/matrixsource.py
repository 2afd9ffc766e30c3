"""Binary int16 matrices as a data source: read by ranges of rows, written as files of each cluster with a commit.

    enable(spark)
    spark.read.format("int16matrix").option("columns", n).load(path)                  # (i, d)
    frame.write.format("int16matrix").mode("append").option("config", text).save(path)   # (cluster, i, d)

A reader's partition is a range of bytes, and a condition on ``i`` narrows the ranges before any byte is read (``enable`` sets what Spark needs for it).  Options:
``columns`` of the file, ``endian`` (little or big), ``repetitions`` (each row is tiled so often), ``partition_bytes``.

The writer takes rows sorted by cluster and i inside each partition (``sorted_for_write``).  Tasks write parts under a name of their attempt; the driver puts the parts of all
tasks in place when the job commits, then each cluster's derived configuration and the number of clusters, and the manifest last.  A job that fails removes what its tasks wrote.
Options: ``config`` (text of the configuration that clusters inherit), ``clusters`` (lines ``c=k``: sub-clusters planned for c, 1 by default), ``endian``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from . import config

PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
MANIFEST = "manifest.json"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _kind(options: dict[str, str]) -> np.dtype:
    return np.dtype(">i2" if options.get("endian", "little") == "big" else "<i2")


@dataclass
class Rows(InputPartition):
    """A range of rows of one file; ``before`` rows lie in earlier files."""

    file: str
    before: int
    first: int
    end: int


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.columns, self.low, self.high = options, int(options["columns"]), 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of i become bounds of rows; every other condition is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("i",) and isinstance(f.value, int):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else 0
                high = f.value + (not isinstance(f, LessThan)) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
                self.low = max(self.low, low)
                self.high = high if self.high is None else self.high if high is None else min(self.high, high)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = open_store(self.options["path"])
        info = store.get_file_info(path)
        found = [info]
        if info.type == fs.FileType.Directory:
            found = sorted((x for x in store.get_file_info(fs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.base_name)
        size, before, out = 2 * self.columns, 0, []
        step = max(1, int(self.options.get("partition_bytes", PARTITION_BYTES)) // size)
        for x in found:
            if x.size is None or x.size % size:
                raise ValueError(f"{x.path} is no whole number of rows of {self.columns} cells")
            n = x.size // size
            first, end = max(0, self.low - before), min(n, n if self.high is None else self.high - before)
            out += [Rows(x.path, before, at, min(at + step, end)) for at in range(first, end, step)]
            before += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.end:
            return
        store, _ = open_store(self.options["path"])
        kind, n, tiles = _kind(self.options), self.columns, int(self.options.get("repetitions", 1))
        step = max(1, BATCH_BYTES // (2 * n * tiles))
        with store.open_input_file(partition.file) as f:
            f.seek(partition.first * 2 * n)
            for at in range(partition.first, partition.end, step):
                rows = min(step, partition.end - at)
                d = np.tile(np.frombuffer(f.read(rows * 2 * n), kind).astype(np.int16).reshape(rows, n), tiles)
                offsets = np.arange(rows + 1, dtype=np.int32) * n * tiles
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + rows, dtype=np.int32) + np.int32(partition.before)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(d.ravel()))], names=["i", "d"])


@dataclass
class Parts(WriterCommitMessage):
    """(cluster, first row, rows, temporary file) of a task."""

    parts: list[tuple[int, int, int, str]]


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, root = open_store(self.options["path"])
        folder = f"{root}/_tmp-{self.job}"
        store.create_dir(folder, recursive=True)
        kind, parts, stream, last = _kind(self.options), [], None, None
        try:
            for b in iterator:
                for cluster, i, d in zip(b.column("cluster").to_pylist(), b.column("i").to_pylist(), b.column("d")):
                    if last is not None and (cluster, i) <= last:
                        raise ValueError("rows must come sorted by cluster and i")
                    if last is None or cluster != last[0]:
                        if stream:
                            stream.close()
                        file = f"{folder}/{uuid.uuid4().hex}"
                        stream = store.open_output_stream(file, compression=None)
                        parts.append([cluster, i, 0, file])
                    stream.write(d.values.to_numpy(zero_copy_only=False).astype(kind).tobytes())
                    parts[-1][2] += 1
                    last = (cluster, i)
        finally:
            if stream:
                stream.close()
        return Parts([tuple(x) for x in parts])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = open_store(self.options["path"])
        there = store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{root} has a matrix already")
        if there:
            for c in json.loads(store.open_input_file(f"{root}/{MANIFEST}").read()):
                store.delete_dir(f"{root}/cluster-{c['cluster']}")
            store.delete_file(f"{root}/{MANIFEST}")
        plan = dict(x.split("=") for x in self.options.get("clusters", "").split())
        by: dict[int, list[tuple[int, int, str]]] = {}
        for m in messages:
            for cluster, first, rows, file in m.parts if m else []:
                by.setdefault(cluster, []).append((first, rows, file))
        manifest = []
        for cluster, parts in sorted(by.items()):
            folder = f"{root}/cluster-{cluster}"
            store.create_dir(folder)
            for k, (_, _, file) in enumerate(sorted(parts)):
                store.move(file, f"{folder}/part-{k:05d}.bin")
            n = sum(rows for _, rows, _ in parts)
            own = {"DistanceMatrixFile": folder, "ClusterFile": f"{root}/cluster-{cluster}.txt", "NumberDataPoints": n, "MaxNcent": int(plan.get(str(cluster), 1))}
            self._text(store, f"{root}/cluster-{cluster}.properties", config.dump(config.parse(self.options.get("config", "")) | own))
            manifest.append({"cluster": cluster, "rows": n, "parts": [{"first": first, "rows": rows} for first, rows, _ in sorted(parts)]})
        pattern = "".join(f"{c['cluster']},{plan.get(str(c['cluster']), 1)},{plan.get(str(c['cluster']), 1)}|" for c in manifest)
        self._text(store, f"{root}/conf_shared.prop", f"numClusters={len(manifest)}\nsubClusters={pattern}\n")
        store.delete_dir(f"{root}/_tmp-{self.job}") if store.get_file_info(f"{root}/_tmp-{self.job}").type != fs.FileType.NotFound else None
        self._text(store, f"{root}/{MANIFEST}", json.dumps(manifest))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = open_store(self.options["path"])
        if store.get_file_info(f"{root}/_tmp-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_tmp-{self.job}")

    @staticmethod
    def _text(store: fs.FileSystem, path: str, text: str) -> None:
        with store.open_output_stream(path, compression=None) as f:
            f.write(text.encode())


class Int16Matrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "int16matrix"

    def schema(self) -> str:
        return "i int, d array<short>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MatrixReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return MatrixWriter(dict(self.options), overwrite)


def enable(spark: SparkSession) -> None:
    """Registers the source and lets conditions on i reach its reader, which Spark asks for as soon as a reader takes any."""
    spark.dataSource.register(Int16Matrix)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def sorted_for_write(rows: DataFrame) -> DataFrame:
    """(cluster, i, d) in ranges of cluster and i, so a large cluster is several parts."""
    return rows.select("cluster", "i", "d").repartitionByRange("cluster", "i").sortWithinPartitions("cluster", "i")


def write_clusters(cells: DataFrame, path: str, text: str = "", plan: dict[int, int] | None = None) -> None:
    """The sub-matrices (cluster, i, j, d) of ``tools.extract`` as files of each cluster with their configurations."""
    from pyspark.sql import functions as F

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("j", F.col("d").cast("short").alias("d")))), lambda x: x["d"])
    rows = cells.groupBy("cluster", "i").agg(ordered.alias("d")).select(F.col("cluster").cast("int").alias("cluster"), F.col("i").cast("int").alias("i"), "d")
    write_rows(rows, path, text, plan)


def write_rows(rows: DataFrame, path: str, text: str = "", plan: dict[int, int] | None = None, endian: str = "little") -> None:
    """The same from row form (cluster, i, d array<short>)."""
    enable(rows.sparkSession)
    out = sorted_for_write(rows).write.format("int16matrix").mode("append").option("config", text).option("endian", endian)
    out.option("clusters", " ".join(f"{c}={k}" for c, k in (plan or {}).items())).save(path)
