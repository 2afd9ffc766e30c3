"""Readers of the engine's text files, and writers of the same lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text
from . import files

#: Fixed header of the timing record.
TIMING = ("Duration(ms)", "HPDuration(us)", "Thread#", "MPIperNode", "Node#", "Pattern", "Parallelism", "Point#/Process", "Point#/Global", "maxNcent", "PTsplitting", "Ratio1", "MPIReduce", "Ratio2", "MPISRBasic", "Ratio3", "MPISREigen", "Ratio4", "MPIBdcast", "Ratio5", "DataFileName", "CurrentTime", "ProcessorName")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def read_points(spark: SparkSession, path: str, first: int = 0, count: int | None = None) -> DataFrame:
    """(idx, x, y, z[, cluster]) of 'idx x y z [cluster]'; a range of indices is a filter, not a position."""
    t = F.split(F.trim("value"), "[\t ]+")
    out = _lines(spark, path).select(t[0].cast("int").alias("idx"), *(t[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")), F.get(t, F.lit(4)).cast("int").alias("cluster"))
    out = out.where(F.col("idx") >= first)
    return out if count is None else out.where(F.col("idx") < first + count)


def read_labels(spark: SparkSession, path: str, first: int = 0, count: int | None = None) -> DataFrame:
    """(idx, name, length) of the indices from ``first`` on; with ``count``, that many are expected and others fail."""
    out = _lines(spark, path).select(text.label_line(F.col("value")).alias("l")).select("l.*").where(F.col("idx") >= first)
    if count is None:
        return out
    out = out.where(F.col("idx") < first + count)
    if (found := out.count()) != count:
        raise ValueError(f"{found} labels where {count} were expected")
    return out


def read_cluster_file(spark: SparkSession, path: str, clusters: int | None = None) -> DataFrame:
    """(idx, cluster) of the tools' files: lines up to the first that has not exactly two tokens; with ``clusters``, ids outside 0 .. clusters - 1 fail when read."""
    t = F.split(F.trim("value"), "\\s+")
    lines = files.numbered_lines(spark, path).withColumn("t", t)
    end = lines.where(F.size("t") != 2).agg(F.min("pos")).first()[0]
    lines = lines if end is None else lines.where(F.col("pos") < end)
    cluster = F.col("t")[1].cast("int")
    if clusters is not None:
        cluster = F.when((cluster < 0) | (cluster >= clusters), F.raise_error(F.lit("cluster number out of range"))).otherwise(cluster)
    return lines.select(F.col("t")[0].cast("int").alias("idx"), cluster.alias("cluster"))


def read_plain_points(spark: SparkSession, path: str) -> DataFrame:
    """(idx, x, y, z): the index is the line's place, whatever its first token says."""
    t = F.split(F.trim("value"), "[\t ]+")
    return files.numbered_lines(spark, path).where(F.trim("value") != "").select(F.col("pos").cast("int").alias("idx"), *(t[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")))


def read_in_step(spark: SparkSession, points: str, numbers: str) -> DataFrame:
    """(idx, x, y, z, cluster): line k of a points file with line k of a file of cluster numbers."""
    left = files.numbered_lines(spark, points)
    right = files.numbered_lines(spark, numbers).select("pos", text.plot_cluster(F.col("value")).alias("cluster"))
    t = F.split(F.trim("value"), "[\t ]+")
    return left.join(right, "pos").select(t[0].cast("int").alias("idx"), *(t[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")), "cluster")


def span(points: DataFrame) -> DataFrame:
    """(largest_point, largest_cluster, clusters) of rows read in step."""
    return points.agg(F.max("idx").alias("largest_point"), F.max("cluster").alias("largest_cluster"), F.countDistinct("cluster").alias("clusters"))


def read_assignment(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(idx, cluster) of 'idx cluster' or 'idx x y z cluster'; a wrong number of rows or a negative cluster fails."""
    out = _lines(spark, path).select(text.cluster_line(F.col("value")).alias("l")).select("l.*")
    out = out.withColumn("cluster", F.when(F.col("cluster") < 0, F.raise_error(F.lit("negative cluster number"))).otherwise(F.col("cluster")))
    if expected is not None and (found := out.count()) != expected:
        raise ValueError(f"{found} cluster rows where {expected} were expected")
    return out


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    """(idx, measure, count, source, method, cluster, name, length); what a line has not is null."""
    return _lines(spark, path).select(text.center_line(F.col("value")).alias("l")).select("l.*")


def read_blocks(spark: SparkSession, path: str, size: int, name: str = r"(\d+)_(\d+)", big_endian: bool = False) -> DataFrame:
    """(bi, bj, r, c, d) of square binary blocks whose file name holds the block row and column; a block is one small file."""
    import numpy as np
    import pyarrow as pa

    kind = ">i2" if big_endian else "<i2"
    file = F.element_at(F.split("path", "/"), -1)
    at = lambda k: F.regexp_extract(file, f"^(?:{name})", k).cast("int")  # noqa: E731  the name's start, not some folder above it
    files = spark.read.format("binaryFile").load(path).where(file.rlike(f"^(?:{name})")).select(at(1).alias("bi"), at(2).alias("bj"), "content")

    def decode(batches):
        for b in batches:
            for bi, bj, content in zip(b.column("bi").to_pylist(), b.column("bj").to_pylist(), b.column("content")):
                d = np.frombuffer(content.as_buffer(), kind).astype(np.int16)
                r, c = np.divmod(np.arange(len(d), dtype=np.int32), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), bi, np.int32)), pa.array(np.full(len(d), bj, np.int32)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(d)], names=["bi", "bj", "r", "c", "d"])

    return files.mapInArrow(decode, "bi int, bj int, r int, c int, d short")


def cluster_file_name(stem: str, largest: int, clusters: int, extension: str = ".txt") -> str:
    return f"{stem}-M{largest}-C{clusters}{extension}"


def write_assignment(assign: DataFrame, path: str) -> None:
    """'idx<TAB>cluster' in files whose order is that of idx: one range-sorted file a partition."""
    assign.repartitionByRange("idx").sortWithinPartitions("idx").select(F.concat_ws("\t", "idx", "cluster").alias("value")).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, column: str, order: list[str], path: str) -> None:
    """Center and plot lines, in order over the files."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def timing_record(duration_ms: float, precise_us: float, threads: int, per_node: int, nodes: int, per_process: int, points: int, max_clusters: int, splitting: float, reduce: float, exchange: float, eigen: float, broadcast: float, data: str, when: str, host: str) -> tuple:
    """The 23 values of a timing line; sub-timers are in ms, and each ratio is their share of the whole, rounded up to four places."""
    share = lambda ms: math.ceil(round(ms / max(duration_ms, 1e-9) * 1e4, 6)) / 1e4
    parts = [y for ms in (splitting, reduce, exchange, eigen, broadcast) for y in (round(ms), share(ms))]
    return (round(duration_ms), round(precise_us), threads, per_node, nodes, f"{threads}x{per_node}x{nodes}", threads * per_node * nodes, per_process, points, max_clusters, *parts, data, when, host)


def write_timing(spark: SparkSession, record: tuple, path: str) -> None:
    """Appends a timing line, behind the header where there is no file yet."""
    if len(record) != len(TIMING):
        raise ValueError(f"a timing record has {len(TIMING)} values")
    head = [] if files.exists(spark, path) else ["\t".join(TIMING)]
    files.write_text(spark, [*head, "\t".join(map(str, record))], path, "append")


def write_summary(spark: SparkSession, log: list[str], path: str) -> None:
    """All log lines behind a blank one."""
    files.write_text(spark, ["", *log], path)


def center_info(centers: DataFrame) -> DataFrame:
    """(cluster, rank, line): tab-joined text of a center."""
    t = lambda c: F.col(c).cast("string")
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(t(c), F.lit(""))) for k, c in (("PointNumber", "idx"), ("Measure", "measure"), ("Method", "method"), ("Group", "cluster"), ("Sequence", "name"), ("Length", "length"))]
    return centers.select("cluster", "rank", F.concat_ws("\t", *parts).alias("line"))


def dated(lines: DataFrame, when: str | None = None) -> DataFrame:
    """Center lines with their date; the time of the query unless it is given."""
    stamp = F.lit(when) if when else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return lines.withColumn("line", F.concat("line", F.lit(' Date="'), stamp, F.lit('"')))


def read_palette(spark: SparkSession, path: str) -> DataFrame:
    """(place, a, r, g, b) of a palette's lines with tokens A=, R=, G= and B=."""
    part = lambda k: F.regexp_extract("value", k + '="?(\\d+)', 1).cast("int")
    return files.numbered_lines(spark, path).where(F.col("value").rlike("A=.*R=")).select((F.row_number().over(Window.orderBy("pos")) - 1).alias("place"), *(part(k).alias(k.lower()) for k in "ARGB"))
