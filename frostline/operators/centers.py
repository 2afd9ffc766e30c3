"""Representative centers of clusters by five methods, and their combined rating.

Pairs are (i, j, d) joined with the small tables of points: cluster, length of the label, and 3-D coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import blocks
from .em import small
from .reductions import k_smallest

#: Bins of the distance histogram.
RADIUS_BINS = 1000


@dataclass(frozen=True)
class Cuts:
    """Thresholds of the pair scan; negative ones are off."""

    min_distance: float = -0.1
    length_a: int = -1
    length_b: int = -1
    links: int = 5
    centers: int = 8


def links(cells: DataFrame, points: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """(cluster, i, j, dist, mds) of ordered pairs inside a cluster that pass the cuts; points(idx, cluster, length, x, y, z).

    Without labels (length null) there is no length cut.
    """
    p = points.select("idx", "cluster", "length", "x", "y", "z")
    a = small(p.select(F.col("idx").alias("i"), "cluster", F.col("length").alias("la"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za")))
    b = small(p.select(F.col("idx").alias("j"), F.col("cluster").alias("cj"), F.col("length").alias("lb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("z").alias("zb")))
    both = cells.where("i <> j").join(a, "i").join(b, "j").where("cluster = cj")
    dist = F.col("d") / 32767.0
    ok = (dist > cuts.min_distance) & (F.coalesce("la", F.lit(1 << 30)) > cuts.length_a) & (F.coalesce("lb", F.lit(1 << 30)) > cuts.length_b)
    return both.where(ok).select("cluster", "i", "j", F.col("d").cast("long").alias("d"), dist.alias("dist"), euclid("a", "b").alias("mds"))


def _own(vectors: DataFrame, points: DataFrame, *more: Column) -> DataFrame:
    """(idx, vector, part, extra) with each point's cluster as its part and length, x, y, z and ``more`` beside its vector; a missing length passes every cut."""
    p = points.where("cluster is not null")
    extra = F.array(F.coalesce("length", F.lit(1 << 30)).cast("double"), *(F.col(c).cast("double") for c in "xyz"), *more)
    return vectors.join(p.select("idx", F.col("cluster").alias("part"), extra.alias("extra")), "idx")


def _kept(cuts: Cuts, d: np.ndarray, i: blocks.Side, j: blocks.Side) -> np.ndarray:
    """Cells that pass the cuts, without those of a point with itself."""
    ok = d / 32767.0 > cuts.min_distance
    for length, least in ((i.extra[:, :1], cuts.length_a), (j.extra[None, :, 0], cuts.length_b)):
        if not (length > least).all():
            ok &= length > least
    if i.ids[0] <= j.ids[-1] and j.ids[0] <= i.ids[-1]:
        ok &= i.ids[:, None] != j.ids
    return ok


def distance_counts(vectors: DataFrame, points: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """(cluster, d, n): how many of the pairs of ``links`` have each distance; only blocks inside a cluster are made, and no pair is kept."""
    return blocks.value_counts(_own(vectors, points), lambda d, i, j: _kept(cuts, d, i, j)).withColumnRenamed("part", "cluster")


def counted_stats(counts: DataFrame) -> DataFrame:
    """``group_stats`` of (cluster, d, n)."""
    n, s = F.sum("n"), F.sum(F.col("d").cast("long") * F.col("n"))
    return counts.groupBy("cluster").agg(n.alias("n"), (s.cast("double") / n / 32767.0).alias("mean"), (F.max("d") / 32767.0).alias("max_d"))


def point_sums(vectors: DataFrame, points: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """(cluster, idx, links, s, mds): number, distances and 3-D distances of a point's pairs of ``links``, added up where their blocks are made."""

    def of(d: np.ndarray, i: blocks.Side, j: blocks.Side) -> tuple[np.ndarray, np.ndarray]:
        ok = _kept(cuts, d, i, j)
        square = np.zeros(d.shape)
        for c in (1, 2, 3):
            x = i.extra[:, c, None] - j.extra[:, c]
            x *= x
            square += x
        mds = np.sqrt(square, out=square)
        return np.zeros(1), np.stack([ok.sum(axis=1), (d * ok).sum(axis=1), (mds * ok).sum(axis=1)], axis=1)[:, None]

    sums = blocks.fold(_own(vectors, points), of, ["links", "s", "mds"]).where("links > 0")
    # one row a point, also where points repeat an id
    return sums.groupBy(F.col("part").alias("cluster"), "idx").agg(F.sum("links").cast("long").alias("links"), F.sum("s").cast("long").alias("s"), F.sum("mds").alias("mds"))


def near_counts(vectors: DataFrame, points: DataFrame, radius: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """(cluster, bucket, idx, near): a point's pairs of ``links`` within each radius of its cluster, counted where their blocks are made; points with none are left out.

    radius(cluster, bucket, radius) has the buckets 0, 1, ... of each cluster with a pair.
    """
    own = radius.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "radius"))), lambda x: x["radius"]).alias("radii"))
    buckets = own.agg(F.max(F.size("radii"))).first()[0] or 0

    def of(d: np.ndarray, i: blocks.Side, j: blocks.Side) -> tuple[np.ndarray, np.ndarray]:
        ok, dist = _kept(cuts, d, i, j), d / 32767.0
        return np.arange(buckets), np.stack([(ok & (dist <= r)).sum(axis=1) for r in i.extra[0, 4:]], axis=1)[:, :, None].astype(np.float64)

    sent = _own(vectors, points.join(small(own), "cluster"), *(F.col("radii")[k] for k in range(buckets)))
    near = blocks.fold(sent, of, ["near"]).where("near > 0")
    return near.groupBy(F.col("part").alias("cluster"), F.col("k").alias("bucket"), "idx").agg(F.sum("near").cast("long").alias("near"))


def euclid(a: str, b: str) -> Column:
    """3-D distance of columns x, y, z with two suffixes."""
    square = lambda c: (F.col(c + a) - F.col(c + b)) * (F.col(c + a) - F.col(c + b))
    return F.sqrt(square("x") + square("y") + square("z"))


def group_stats(pairs: DataFrame) -> DataFrame:
    """(cluster, n, mean, max_d): over the cut pairs, exact integer sums."""
    return pairs.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), (F.sum("d").cast("double") / F.count(F.lit(1)) / 32767.0).alias("mean"), (F.max("d") / 32767.0).alias("max_d"))


def eligible(points: DataFrame, cuts: Cuts) -> DataFrame:
    """(cluster, members, link_cut): groups larger than the number of centers."""
    g = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > cuts.centers)
    return g.withColumn("link_cut", F.greatest(F.lit(1), F.least(F.lit(cuts.links), F.col("members") - 20)))


def _pair_sums(pairs: DataFrame) -> DataFrame:
    """``point_sums`` of pairs."""
    return pairs.groupBy("cluster", F.col("i").alias("idx")).agg(F.count(F.lit(1)).alias("links"), F.sum("d").alias("s"), F.sum("mds").alias("mds"))


def _enough(sums: DataFrame, points: DataFrame, cuts: Cuts) -> DataFrame:
    """The sums of points that have enough cut pairs."""
    return sums.join(F.broadcast(eligible(points, cuts)), "cluster").where("links >= link_cut")


def by_mean_distance(pairs: DataFrame, points: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """(cluster, idx, measure, rank): least mean distance to members."""
    return summed_mean_distance(_pair_sums(pairs), points, cuts)


def summed_mean_distance(sums: DataFrame, points: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """``by_mean_distance`` of ``point_sums``."""
    v = _enough(sums, points, cuts).select("cluster", "idx", (F.col("s").cast("double") / F.col("links") / 32767.0).alias("measure"))
    return k_smallest(v, ["cluster"], "measure", "idx", cuts.centers)


def by_mds_distance(pairs: DataFrame, points: DataFrame, cuts: Cuts = Cuts(), digits: int = 9) -> DataFrame:
    """Least mean 3-D distance, over the links of the point; rounded before ranking so that summation order cannot change ranks."""
    return summed_mds_distance(_pair_sums(pairs), points, cuts, digits)


def summed_mds_distance(sums: DataFrame, points: DataFrame, cuts: Cuts = Cuts(), digits: int = 9) -> DataFrame:
    """``by_mds_distance`` of ``point_sums``."""
    v = _enough(sums, points, cuts).select("cluster", "idx", F.round(F.col("mds") / F.col("links"), digits).alias("measure"))
    return k_smallest(v, ["cluster"], "measure", "idx", cuts.centers)


def gravity(points: DataFrame) -> DataFrame:
    """(cluster, cx, cy, cz)."""
    return points.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))


def by_gravity(points: DataFrame, cuts: Cuts = Cuts(), digits: int = 9) -> DataFrame:
    """Least distance to the centre of gravity."""
    g = points.join(F.broadcast(gravity(points)), "cluster").join(F.broadcast(eligible(points, cuts).select("cluster")), "cluster")
    square = lambda c: (F.col(c) - F.col("c" + c)) * (F.col(c) - F.col("c" + c))
    v = g.select("cluster", "idx", F.round(F.sqrt(square("x") + square("y") + square("z")), digits).alias("measure"))
    return k_smallest(v, ["cluster"], "measure", "idx", cuts.centers)


def mds_group_mean(pairs: DataFrame) -> DataFrame:
    """(cluster, n, mds_mean) over ordered pairs."""
    return pairs.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("mds").alias("mds_mean"))


def summed_mds_mean(sums: DataFrame) -> DataFrame:
    """``mds_group_mean`` of ``point_sums``."""
    return sums.groupBy("cluster").agg(F.sum("links").alias("n"), (F.sum("mds") / F.sum("links")).alias("mds_mean"))


def distance_histogram(pairs: DataFrame, bins: int = RADIUS_BINS) -> DataFrame:
    """(cluster, bin, n): equal bins of [0, max] of the cluster; the maximum falls into the last."""
    return counted_histogram(pairs.withColumn("n", F.lit(1)), bins)


def counted_histogram(counts: DataFrame, bins: int = RADIUS_BINS) -> DataFrame:
    """``distance_histogram`` of (cluster, d, n)."""
    top = F.broadcast(counts.groupBy("cluster").agg(F.max("d").alias("top")))
    bin_of = F.least(F.floor(F.col("d").cast("long") * F.lit(bins) / F.greatest(F.col("top"), F.lit(1))), F.lit(bins - 1)).cast("int")
    return counts.join(top, "cluster").groupBy("cluster", bin_of.alias("bin")).agg(F.sum("n").alias("n"))


def radii(hist: DataFrame, stats: DataFrame, fractions: list[float], bins: int = RADIUS_BINS) -> DataFrame:
    """(cluster, bucket, radius): the middle of the first bin before which a fraction of all pairs lies; 0 if none is.

    The running count orders at most ``bins`` rows a cluster.
    """
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cluster").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = F.lead("bin").over(Window.partitionBy("cluster").orderBy("bin"))
    run = hist.withColumn("before", before).withColumn("through", F.col("before") + F.col("n")).withColumn("next", F.coalesce(filled, F.lit(bins)))
    f = F.explode(F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(x).alias("fraction")) for b, x in enumerate(fractions)))).alias("f")
    want = stats.select("cluster", F.col("n").alias("total"), "max_d", f).select("cluster", "total", "max_d", "f.bucket", "f.fraction")
    # the first bin whose prior count reaches the target follows the bin that crosses it
    hit = run.join(F.broadcast(want), "cluster").where((F.col("through") >= F.col("fraction") * F.col("total")) & (F.col("before") < F.col("fraction") * F.col("total")) & (F.col("bin") < bins - 1))
    r = hit.groupBy("cluster", "bucket").agg(F.min((F.col("bin") + 1 + 0.5) / bins * F.col("max_d")).alias("radius"))
    return want.select("cluster", "bucket").join(r, ["cluster", "bucket"], "left").select("cluster", "bucket", F.coalesce("radius", F.lit(0.0)).alias("radius"))


def by_bucket(pairs: DataFrame, points: DataFrame, radius: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """(cluster, bucket, idx, measure, rank): most members within the radius, as members less that count; points with none are left out."""
    near = pairs.join(F.broadcast(radius), "cluster").where(F.col("dist") <= F.col("radius")).groupBy("cluster", "bucket", F.col("i").alias("idx")).agg(F.count(F.lit(1)).alias("near"))
    return counted_bucket(near, points, cuts)


def counted_bucket(near: DataFrame, points: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """``by_bucket`` of ``near_counts``."""
    v = near.join(F.broadcast(eligible(points, cuts)), "cluster").select("cluster", "bucket", "idx", (F.col("members") - F.col("near")).alias("measure"))
    return k_smallest(v, ["cluster", "bucket"], "measure", "idx", cuts.centers)


def ratings(mean: DataFrame, mds: DataFrame, gravity_: DataFrame, bucket: DataFrame, buckets: int) -> DataFrame:
    """(cluster, idx, seq, coord, count, rating): weights 1 for the mean and the two coordinate methods, 1/buckets for each bucket, whose rank is divided as an integer."""
    one = lambda df, kind: df.select("cluster", "idx", F.lit(kind).alias("kind"), F.lit(1.0).alias("w"), (F.col("rank") - 1).cast("double").alias("r"))
    many = bucket.select("cluster", "idx", F.lit("seq").alias("kind"), F.lit(1.0 / buckets).alias("w"), F.floor((F.col("rank") - 1) / buckets).cast("double").alias("r"))
    rows = one(mean, "seq").unionByName(one(mds, "coord")).unionByName(one(gravity_, "coord")).unionByName(many)
    has = lambda k: F.max((F.col("kind") == k).cast("int"))
    return rows.groupBy("cluster", "idx").agg(has("seq").alias("seq"), has("coord").alias("coord"), F.round(F.sum("w"), 9).alias("count"), F.round(F.sum("r"), 9).alias("rating"))


def overall_best(rated: DataFrame, k: int, least: float = 0.6) -> DataFrame:
    """(cluster, idx, measure, source, rank): least rating a count, of those counted enough."""
    source = F.when((F.col("seq") == 1) & (F.col("coord") == 1), "Both").when(F.col("coord") == 1, "MDS").otherwise("Seq")
    v = rated.where(F.col("count") > least).select("cluster", "idx", F.round(F.col("rating") / F.col("count"), 9).alias("measure"), source.alias("source"))
    return k_smallest(v, ["cluster"], "measure", "idx", k)


def center_distances(top: DataFrame, cells: DataFrame) -> DataFrame:
    """(cluster, idx, mean_other, to_top) of each center to the other centers of its cluster."""
    a = top.select("cluster", F.col("idx").alias("i"), "rank")
    b = top.select(F.col("cluster").alias("cb"), F.col("idx").alias("j"), F.col("rank").alias("rb"))
    # at most K centers a cluster: the join makes K x K rows each
    pairs = a.join(b, (F.col("cluster") == F.col("cb")) & (F.col("i") != F.col("j")))
    d = cells.join(small(pairs), ["i", "j"])
    first = F.max(F.when(F.col("rb") == 1, F.col("d") / 32767.0))
    return d.groupBy("cluster", F.col("i").alias("idx")).agg((F.sum(F.col("d").cast("long")).cast("double") / F.count(F.lit(1)) / 32767.0).alias("mean_other"), F.coalesce(first, F.lit(0.0)).alias("to_top"))


def center_cells(top: DataFrame, vectors: DataFrame) -> DataFrame:
    """(i, j, d) between the centers of a cluster, the only cells that ``center_distances`` reads."""
    chosen = top.select("idx", F.col("cluster").alias("part"))
    return blocks.part_cells(vectors.join(small(chosen), "idx")).drop("part")


def center_lines(top: DataFrame, method: str, points: DataFrame) -> DataFrame:
    """(cluster, rank, line): the center file's lines without their date."""
    named = top.join(points.select("idx", "name", "length"), "idx", "left")
    label = F.when(F.col("name").isNotNull(), F.format_string(" Sequence=%s Length=%d", "name", F.col("length"))).otherwise("")
    return named.select("cluster", "rank", F.concat(F.format_string("PointNumber=%-6d Measure=%.6f Method=%s Group=%d", F.col("idx").cast("long"), F.col("measure").cast("double"), F.lit(method), F.col("cluster").cast("long")), label).alias("line"))


def center_coordinate_distances(top: DataFrame, points: DataFrame) -> DataFrame:
    """(cluster, idx, mean_other, to_top) of each center to the others of its cluster by 3-D distance, for the methods that use coordinates."""
    p = points.select("idx", "x", "y", "z")
    a = top.select("cluster", "idx").join(p, "idx").select("cluster", F.col("idx").alias("i"), *(F.col(c).alias(c + "a") for c in "xyz"))
    b = top.select(F.col("cluster").alias("cb"), "idx", "rank").join(p, "idx").select("cb", F.col("idx").alias("j"), F.col("rank").alias("rb"), *(F.col(c).alias(c + "b") for c in "xyz"))
    d = a.join(b, (F.col("cluster") == F.col("cb")) & (F.col("i") != F.col("j"))).withColumn("d", euclid("a", "b"))
    first = F.max(F.when(F.col("rb") == 1, F.col("d")))
    return d.groupBy("cluster", F.col("i").alias("idx")).agg(F.round(F.avg("d"), 9).alias("mean_other"), F.round(F.coalesce(first, F.lit(0.0)), 9).alias("to_top"))


def averages(by_distance: dict[str, DataFrame], by_coordinate: dict[str, DataFrame], cells: DataFrame, points: DataFrame) -> DataFrame:
    """(method, cluster, idx, mean_other, to_top) of every method's centers, each by the kind of distance it ranks by."""
    parts = [center_distances(top, cells).withColumn("method", F.lit(m)) for m, top in by_distance.items()]
    parts += [center_coordinate_distances(top, points).withColumn("method", F.lit(m)) for m, top in by_coordinate.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("method", "cluster", "idx", "mean_other", "to_top")


def average_lines(rows: DataFrame) -> DataFrame:
    """(cluster, line) of ``averages``."""
    return rows.select("cluster", F.format_string("Method=%s Group=%d PointNumber=%-6d MeanToOthers=%.6f ToFirst=%.6f", "method", F.col("cluster").cast("long"), F.col("idx").cast("long"), "mean_other", "to_top").alias("line"))
