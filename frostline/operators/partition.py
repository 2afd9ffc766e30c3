"""Decompositions of an index range, and ranges as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def even(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """(part, start, len): contiguous, the first n mod parts one longer."""
    size, rest = n // parts, n % parts
    p = F.col("id").cast("int")
    start = (p * size + F.least(p, F.lit(rest))).cast("int")
    return spark.range(parts).select(p.alias("part"), start.alias("start"), (F.lit(size) + (p < rest).cast("int")).cast("int").alias("len"))


def by_length(spark: SparkSession, n: int, length: int) -> DataFrame:
    p = F.col("id").cast("int")
    return spark.range(-(-n // length)).select(p.alias("part"), (p * length).alias("start"), F.least(F.lit(length), F.lit(n) - p * length).cast("int").alias("len"))


def owner(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points(idx) with the part whose range holds them.

    Ranges of an even decomposition are few (one a process), so the range join is a broadcast of that list.
    """
    return points.join(F.broadcast(ranges), (F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("start") + F.col("len"))).select("idx", "part")


def contains(start: Column, end: Column, x: Column) -> Column:
    return (x >= start) & (x <= end)


def intersects(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


def intersection(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """struct(start, end) or null."""
    return F.when(intersects(a0, a1, b0, b1), F.struct(F.greatest(a0, b0).alias("start"), F.least(a1, b1).alias("end")))
