"""Rounds of cluster, join, extract, recluster and collate, without intermediate files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..operators import anneal, anneal_tables, blocks, tools


def cluster(cells: DataFrame, n: int, options: anneal.Options, initial: float | None = None) -> DataFrame:
    """(idx, cluster) of an anneal over (i, j, d)."""
    return anneal_tables.anneal(blocks.from_cells(cells), options, initial)[0]


def recluster(cells: DataFrame, assign: DataFrame, joins: dict[int, int], plan: dict[int, int], options: anneal.Options) -> DataFrame:
    """Join clusters, cluster each planned one again into plan[c] parts, and number all parts consecutively.

    The planned clusters' matrices are blocks of one table, and all are annealed together: a pass over all of them is one job.
    """
    joined = tools.join_clusters(assign, joins).persist()
    planned = [r["cluster"] for r in joined.where(F.col("cluster").isin(list(plan))).select("cluster").distinct().collect()]
    if not planned:
        return joined
    own = tools.extract(cells, joined, planned).withColumnRenamed("cluster", "part")
    labels, _ = anneal_tables.anneal_parts(blocks.from_cells(own), {c: replace(options, max_clusters=plan[c]) for c in planned})
    return tools.collate(joined, labels.select(F.col("part").alias("cluster"), F.col("idx").cast("long").alias("pos"), F.col("cluster").alias("sub")))
