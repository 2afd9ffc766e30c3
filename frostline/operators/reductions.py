"""Distributed reductions: scalar, element-wise and indexed aggregates with the tie and floor rules of the pairwise engine.

Vectors are array columns; element-wise aggregates explode them with their position, so partial sums combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def bool_or(x: Column) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def count_and_sum(x: Column) -> tuple[Column, Column]:
    return F.count(x), F.coalesce(F.sum(x), F.lit(0))


def floored_max(x: Column) -> Column:
    """Maximum that is never under 0."""
    return F.greatest(F.lit(0.0), F.coalesce(F.max(x), F.lit(0.0)))


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def mean_sigma(x: Column) -> tuple[Column, Column, Column]:
    """Count, mean and population deviation by moments; zero when empty."""
    n, mean = F.count(x), F.coalesce(F.avg(x), F.lit(0.0))
    return n, mean, F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.avg(x * x), F.lit(0.0)) - mean * mean))


def histogram(df: DataFrame, bin_of: Column, bins: int, by: list[str]) -> DataFrame:
    """Counts per bin; bins out of range are ignored."""
    return df.withColumn("bin", bin_of.cast("int")).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def elements(df: DataFrame, vector: Column, by: list[str]) -> DataFrame:
    return df.select(*by, F.posexplode(vector).alias("pos", "value"))


def element_sum(df: DataFrame, vector: Column, by: list[str]) -> DataFrame:
    return elements(df, vector, by).groupBy(*by, "pos").agg(F.sum("value").alias("value"))


def element_max(df: DataFrame, vector: Column, by: list[str], floor: float = -1e10) -> DataFrame:
    return elements(df, vector, by).groupBy(*by, "pos").agg(F.greatest(F.lit(floor), F.max("value")).alias("value"))


def element_mean(df: DataFrame, vector: Column, by: list[str]) -> DataFrame:
    return elements(df, vector, by).groupBy(*by, "pos").agg(F.avg("value").alias("value"))


def scatter_add(df: DataFrame, locations: Column, values: Column, by: list[str]) -> DataFrame:
    """Adds each value at its own location."""
    pairs = df.select(*by, F.explode(F.arrays_zip(locations.alias("location"), values.alias("value"))).alias("x"))
    return pairs.groupBy(*by, F.col("x.location").alias("location")).agg(F.sum("x.value").alias("value"))


def argmin_first(value: Column, index: Column) -> Column:
    """struct(v, i): the first index on ties."""
    return F.min(F.struct(value.alias("v"), index.alias("i")))


def argmax_last(value: Column, index: Column) -> Column:
    """struct(v, i): the last index on ties."""
    return F.max(F.struct(value.alias("v"), index.alias("i")))


def k_smallest(df: DataFrame, by: list[str], value: str, index: str, k: int) -> DataFrame:
    """Rows of the k least (value, index) of each group, with their rank from 1.

    Spark cuts each task's rows to k a group before the shuffle (window group limit), so a hot group does not gather.
    """
    w = Window.partitionBy(*by).orderBy(value, index)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
