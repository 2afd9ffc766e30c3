"""Inputs of the registered queries, derived from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.distance import from_vectors

D = """WITH e AS (SELECT CAST(vec_id AS INTEGER) AS i, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT a.i, b.i AS j, CAST(round(32767 * (1 - list_dot_product(a.v, b.v)) / 2) AS INTEGER) AS d FROM e a CROSS JOIN e b)"""
POINTS = """p AS (SELECT CAST(vec_id AS INTEGER) AS idx, label AS cluster, source AS name, CAST(n_chars AS INTEGER) AS length,
CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z
FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("idx"), F.col("embedding").alias("vector"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_vectors(vectors(spark, sf_dir))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("idx"), F.col("label").cast("int").alias("cluster"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, cluster, name, length, x, y, z."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("name"), F.col("n_chars").cast("int").alias("length"))
    at = lambda k: F.col("embedding")[k].cast("double")
    return e.select(F.col("vec_id").cast("int").alias("idx"), F.col("label").cast("int").alias("cluster"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), "vec_id").join(docs, F.col("vec_id") == F.col("doc_id"), "left").select("idx", "cluster", "name", "length", "x", "y", "z")


def count(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
