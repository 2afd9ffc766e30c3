"""Connected components of a growing edge set, in tables: no edge, label or group ever comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import table


def contract(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """New labels(node, root) after adding edges(a, b); root is the smallest node of a component.

    labels holds only nodes whose root is not themselves, so it follows the number of linked nodes.
    Edges are first mapped to roots; each round gives every root its least neighbour and then that one's own choice
    (pointer jumping), until nothing changes.
    """

    def root_of(df: DataFrame, col: str) -> DataFrame:
        known = labels.select(F.col("node").alias(col), F.col("root").alias(f"r_{col}"))
        return df.join(known, col, "left").withColumn(f"r_{col}", F.coalesce(f"r_{col}", col))

    both = root_of(root_of(edges, "a"), "b").select(F.col("r_a").alias("a"), F.col("r_b").alias("b")).where("a <> b")
    both = table(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    now = table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "cc-step")
    while True:
        jumped = now.join(now.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        far = jumped.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        nearest = both.join(far, "b").groupBy("a").agg(F.min("seen").alias("seen"))
        step = jumped.join(nearest, F.col("node") == F.col("a"), "left").select("node", F.least("root", "seen").alias("root"))
        then = table(step, "cc-step")
        changed = then.join(now.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        now = then
        if not changed:
            break
    moved = labels.join(now.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    fresh = now.where("node <> root")
    return table(moved.join(fresh.select("node"), "node", "left_anti").union(fresh), "cc-labels")
