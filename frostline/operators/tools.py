"""Tools on cluster assignments and matrices: join, extract, collate, merge blocks, plot."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import blocks, em

DUST = 100_000


def join_map(joins: dict[int, int]) -> dict[int, int]:
    """other -> main, followed to its end; raises on a cycle."""
    out = {}
    for other in joins:
        seen, main = {other}, joins[other]
        while main in joins:
            if main in seen:
                raise ValueError(f"cluster joins form a cycle at {main}")
            seen.add(main)
            main = joins[main]
        out[other] = main
    return out


def mapped(cluster: Column, joins: dict[int, int]) -> Column:
    """The joins are the arguments of a tool, so the map is a literal."""
    if not joins:
        return cluster
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in joins.items() for x in kv)), cluster), cluster)


def join_clusters(assign: DataFrame, joins: dict[int, int]) -> DataFrame:
    """(idx, cluster): ids renumbered from 0 without the merged ones, which take their main's new id; dust stays."""
    to = assign.withColumn("cluster", mapped(F.col("cluster"), join_map(joins)))
    ids = to.where(F.col("cluster") != DUST).select("cluster").distinct()
    # one row a cluster: a single window over the distinct ids
    numbered = ids.select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).alias("new"))
    return to.join(F.broadcast(numbered), "cluster", "left").select("idx", F.coalesce("new", F.lit(DUST)).cast("int").alias("cluster"))


def ordinals(assign: DataFrame) -> DataFrame:
    """(idx, cluster, pos): place of a point in its cluster, from 0."""
    return assign.select("idx", "cluster", (F.row_number().over(Window.partitionBy("cluster").orderBy("idx")) - 1).alias("pos"))


def extract(cells: DataFrame, assign: DataFrame, clusters: list[int], joins: dict[int, int] | None = None) -> DataFrame:
    """(cluster, i, j, d): the sub-matrix of each listed cluster, re-indexed from 0; joined clusters are extracted once, under their main."""
    kept = assign.withColumn("cluster", mapped(F.col("cluster"), join_map(joins or {}))).where(F.col("cluster").isin(clusters))
    place = ordinals(kept)
    a = place.select(F.col("idx").alias("i"), "cluster", F.col("pos").alias("a"))
    b = place.select(F.col("idx").alias("j"), F.col("cluster").alias("cj"), F.col("pos").alias("b"))
    return cells.join(a, "i").join(b, "j").where("cluster = cj").select("cluster", F.col("a").alias("i"), F.col("b").alias("j"), "d")


def _placed(vectors: DataFrame, assign: DataFrame, clusters: list[int], joins: dict[int, int] | None) -> DataFrame:
    """(idx, vector, part): the points of the listed clusters with their place in the cluster, joined or not, as idx and the cluster as part."""
    kept = assign.withColumn("cluster", mapped(F.col("cluster"), join_map(joins or {}))).where(F.col("cluster").isin(clusters))
    return vectors.join(ordinals(kept), "idx").select(F.col("pos").alias("idx"), "vector", F.col("cluster").alias("part"))


def extract_vectors(vectors: DataFrame, assign: DataFrame, clusters: list[int], joins: dict[int, int] | None = None) -> DataFrame:
    """``extract`` of the distances of vectors(idx, vector): only the listed clusters' blocks are made."""
    return blocks.part_cells(_placed(vectors, assign, clusters, joins)).withColumnRenamed("part", "cluster")


def extract_row_sums(vectors: DataFrame, assign: DataFrame, clusters: list[int], joins: dict[int, int] | None = None) -> DataFrame:
    """(cluster, i, s, n): sum and number of each row's cells in the same sub-matrices, none of which is kept."""
    return blocks.row_sums(_placed(vectors, assign, clusters, joins)).select(F.col("part").alias("cluster"), F.col("idx").alias("i"), "s", "n")


def extract_rows(rows: DataFrame, assign: DataFrame, clusters: list[int]) -> DataFrame:
    """(cluster, i, d): the same sub-matrices in row form from rows(i, d array<short>), without making a cell.

    The ids of a cluster are one array, never longer than a row.  They and the points' places are broadcast up to ``em.BROADCAST_ROWS`` points and joined beyond it.
    A point outside the matrix raises.
    """
    place = ordinals(assign.where(F.col("cluster").isin(clusters)))
    few = place.limit(em.BROADCAST_ROWS + 1).count() <= em.BROADCAST_ROWS
    side = F.broadcast if few else lambda df: df
    members = place.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"]).alias("members"))
    own = rows.join(side(place.select(F.col("idx").alias("i"), "cluster", "pos")), "i").join(side(members), "cluster")
    return own.select("cluster", F.col("pos").cast("int").alias("i"), F.transform("members", lambda m: F.element_at("d", m + 1)).alias("d"))


def reindexed_points(points: DataFrame, assign: DataFrame, clusters: list[int]) -> DataFrame:
    """(cluster, pos, x, y, z, one): coordinates of listed clusters with new indices and cluster column 1."""
    place = ordinals(assign.where(F.col("cluster").isin(clusters)))
    return points.select("idx", "x", "y", "z").join(place, "idx").select("cluster", "pos", "x", "y", "z", F.lit(1).alias("one"))


def subcluster_pattern(assign: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """(pattern,): 'c,k,k|' for each cluster with its number of sub-clusters, in order of c."""
    rows = assign.select("cluster").distinct().where(F.col("cluster").isin(list(wanted))).withColumn("k", F.element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), F.col("cluster")))
    listed = F.array_sort(F.collect_list(F.struct("cluster", "k")))
    return rows.agg(F.array_join(F.transform(listed, lambda x: F.format_string("%d,%d,%d|", x["cluster"], x["k"], x["k"])), "").alias("pattern"))


def collate(assign: DataFrame, subs: DataFrame, joins: dict[int, dict[int, int]] | None = None, dust: int | None = None) -> DataFrame:
    """(idx, cluster): sub-cluster ids of every cluster as consecutive global ids; subs(cluster, pos, sub).

    joins merges sub-ids of one cluster first; sub-ids equal to ``dust`` become dust; clusters without sub-clusters are one each.
    """
    place = ordinals(assign).join(subs, ["cluster", "pos"], "left")
    sub = F.coalesce("sub", F.lit(0))
    for c, m in (joins or {}).items():
        sub = F.when(F.col("cluster") == c, mapped(sub, join_map(m))).otherwise(sub)
    place = place.withColumn("sub", sub)
    live = place if dust is None else place.where(F.col("sub") != dust)
    ids = live.select("cluster", "sub").distinct()
    numbered = ids.select("cluster", "sub", (F.row_number().over(Window.orderBy("cluster", "sub")) - 1).alias("new"))
    return place.join(F.broadcast(numbered), ["cluster", "sub"], "left").select("idx", F.coalesce("new", F.lit(DUST)).cast("int").alias("cluster"))


def collate_planned(assign: DataFrame, subs: DataFrame, plan: dict[int, int], clusters: int, joins: dict[int, dict[int, int]] | None = None) -> DataFrame:
    """(idx, cluster): sub-clusters numbered as declared, whether or not they have points.

    Each of the clusters 0 .. ``clusters`` - 1 has plan[c] sub-clusters, or one where it is not planned; a joined sub-id takes its main's number.  Dust stays; a point
    of a planned cluster without a declared sub-id, and one of a cluster that is not declared, raise.
    """
    numbers, at = [], 0
    for c in range(clusters):
        into, own = join_map((joins or {}).get(c, {})), {}
        for k in range(plan.get(c, 1)):
            if k not in into:
                own[k], at = at, at + 1
        if lost := [k for k in range(plan.get(c, 1)) if into.get(k, k) not in own]:
            raise ValueError(f"sub-clusters {lost} of cluster {c} are joined to none that is declared")
        numbers += [(c, k, own[into.get(k, k)]) for k in range(plan.get(c, 1))]
    new = assign.sparkSession.createDataFrame(numbers, "cluster int, sub int, new int")
    place = ordinals(assign.where(F.col("cluster") != DUST)).join(subs, ["cluster", "pos"], "left")
    sub = F.when(F.col("cluster").isin(list(plan)), F.col("sub")).otherwise(F.lit(0)) if plan else F.lit(0)
    # the declared numbers are the arguments of the call
    numbered = place.withColumn("sub", sub).join(F.broadcast(new), ["cluster", "sub"], "left")
    known = F.when(F.col("new").isNull(), F.raise_error(F.format_string("point %d of cluster %d has no declared sub-cluster", F.col("idx").cast("long"), F.col("cluster").cast("long")))).otherwise(F.col("new"))
    return numbered.select("idx", known.cast("int").alias("cluster")).unionByName(assign.where(F.col("cluster") == DUST).select("idx", F.lit(DUST).alias("cluster")))


def offsets(counts: DataFrame) -> DataFrame:
    """(cluster, first): running offset of each cluster's sub-clusters; counts(cluster, k)."""
    w = Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("cluster", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("first"))


def plot(points: DataFrame, assign: DataFrame) -> DataFrame:
    """(idx, line): 'idx x y z cluster label' joined by index; dust is labelled so."""
    label = F.when(F.col("cluster") == DUST, "Dust").otherwise(F.col("cluster").cast("string"))
    return points.drop("cluster").join(assign, "idx").select("idx", F.concat_ws(" ", F.col("idx").cast("string"), *(F.format_string("%.6f", c) for c in ("x", "y", "z")), F.col("cluster").cast("string"), label).alias("line"))


def zip_by_position(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of two tables by rank in ``order``: the positional form of ``plot``.

    The rank is made by sorting in ranges and adding the sizes of earlier ranges, not by one window over everything.
    """

    def ranked(df: DataFrame) -> DataFrame:
        cut = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
        cut = cut.persist()
        before = cut.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
        local = F.row_number().over(Window.partitionBy("part").orderBy(order))
        return cut.join(F.broadcast(before), "part").withColumn("rn", (local + F.col("before") - 1).cast("long")).drop("part", "before")

    return ranked(left).join(ranked(right).withColumnRenamed(order, order + "_right"), "rn")


def merge_blocks(blocks: DataFrame, size: int, skip: list[int] | None = None) -> DataFrame:
    """(i, j, d) of the whole matrix from blocks(bi, bj, r, c, d); a missing block is taken transposed from its mirror.  Skipped block rows and columns are left out."""
    kept = blocks.where(~F.col("bi").isin(skip or []) & ~F.col("bj").isin(skip or []))
    given = kept.select("bi", "bj").distinct()
    mirror = kept.join(given.select(F.col("bi").alias("bj"), F.col("bj").alias("bi")), ["bi", "bj"], "left_anti").select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), F.col("c").alias("r"), F.col("r").alias("c"), "d")
    return kept.unionByName(mirror).select((F.col("bi") * size + F.col("r")).cast("int").alias("i"), (F.col("bj") * size + F.col("c")).cast("int").alias("j"), "d")


def plot_xml(points: DataFrame) -> DataFrame:
    """(idx, xml): one point element of a plot file; points(idx, cluster, label, x, y, z)."""
    el = F.format_string("<point><key>%d</key><clusterkey>%d</clusterkey><label>%s</label><location x=\"%.6f\" y=\"%.6f\" z=\"%.6f\"/></point>", F.col("idx").cast("long"), F.col("cluster").cast("long"), "label", "x", "y", "z")
    return points.select("idx", el.alias("xml"))


def cluster_xml(clusters: DataFrame) -> DataFrame:
    """(key, xml): one cluster element of a plot file; clusters(key, label, a, r, g, b, size, shape)."""
    el = F.format_string('<cluster><key>%d</key><label>%s</label><visible>1</visible><default>0</default><color r="%d" g="%d" b="%d" a="%d"/><size>%d</size><shape>%d</shape></cluster>', F.col("key").cast("long"), "label", *(F.col(c).cast("long") for c in ("r", "g", "b", "a", "size", "shape")))
    return clusters.select("key", el.alias("xml"))


def palette(spark: SparkSession, size: int = 50) -> DataFrame:
    """(place, a, r, g, b): hues evenly around the circle, in steps that keep neighbours apart; stands in for a palette file."""
    rows = [(k, 255, *(round(255 * x) for x in colorsys.hsv_to_rgb(k * 0.381966 % 1, 0.85, 0.9 - 0.2 * (k % 3)))) for k in range(size)]
    return spark.createDataFrame(rows, "place int, a int, r int, g int, b int")


def coloured(assign: DataFrame, colours: DataFrame) -> DataFrame:
    """(key, label, a, r, g, b, size, shape) of each cluster, as ``cluster_xml`` takes it: colours(place, a, r, g, b) are dealt around by cluster number."""
    colours = colours.select("place", "a", "r", "g", "b")
    keys = assign.select(F.col("cluster").cast("int").alias("key")).distinct()
    label = F.when(F.col("key") == DUST, "Dust").otherwise(F.col("key").cast("string"))
    dealt = keys.join(F.broadcast(colours.agg(F.count(F.lit(1)).alias("colours"))), how="cross")  # one row beside each cluster
    dealt = dealt.withColumn("place", F.pmod("key", F.col("colours")).cast("int"))
    return dealt.join(em.small(colours), "place").select("key", label.alias("label"), "a", "r", "g", "b", F.lit(1).alias("size"), F.lit(3).alias("shape"))


def center_plot_numbers(centers: DataFrame, methods: int, highest: Column) -> DataFrame:
    """(cluster, method, number): plot cluster of a group's centers by method, above all real clusters."""
    m = F.dense_rank().over(Window.orderBy("method")) - 1
    names = centers.select("method").distinct().select("method", m.alias("m"))
    return centers.join(F.broadcast(names), "method").select("cluster", "method", (F.col("cluster") * methods + F.col("m") + highest + 1).alias("number"))

