"""Runs of the tools from their sections of a configuration to files: extract clusters, collate their new labels, merge blocks.

Every run is a chain of DataFrame steps between readers and writers; the driver holds the configuration and, of ``merge``, the sizes of the diagonal blocks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as lines
from ..operators import blocks, tools
from ..sources import config, files, matrixsource, textfiles


def _numbers(listed: str) -> list[int]:
    return [int(x) for x in listed.replace('"', "").split(",") if x.strip()]


def extract(spark: SparkSession, text: str, overrides: dict[str, str] | None = None, points: str | None = None, template: str = "") -> list[int]:
    """The sub-matrix of each listed cluster as binary files under outDir, with its derived configuration and the shared one; returns the clusters.

    Joins are applied first, so a joined cluster is extracted under its main.  ``newclusters`` gives the parts planned for each listed cluster, 1 where it is shorter;
    ``template`` is the configuration that the derived ones inherit; with a file of ``points`` each cluster's coordinates are written too (mds/cluster=c), indexed from 0.
    Listed clusters without points are left out; an assignment to a point outside the matrix raises.
    """
    s = config.section(text, config.EXTRACTOR, overrides)
    if not s["clusters"] or s["clusters"] == "None":
        raise ValueError("clusters must list what is to be extracted")
    listed, new, n, out = _numbers(s["clusters"]), _numbers(s["newclusters"]), s["numPoints"], s["outDir"]
    plan = {c: new[k] if k < len(new) else 1 for k, c in enumerate(listed)}
    joins = lines.parse_joins(s["joins"].replace('"', ""))
    assign = textfiles.read_assignment(spark, s["clusterFile"], n)
    own = assign.withColumn("cluster", tools.mapped(F.col("cluster"), tools.join_map(joins))).where(F.col("cluster").isin(listed)).persist()
    low, high = own.agg(F.min("idx"), F.max("idx")).first()
    if low is None:
        raise ValueError("no listed cluster has a point")
    matrixsource.enable(spark)
    endian = "big" if s["isBigEndian"] else "little"
    # the bounds reach the reader where filters are pushed down, so rows before the first and behind the last point are not read
    rows = spark.read.format("int16matrix").option("columns", n).option("endian", endian).load(s["distFile"]).where(F.col("i").between(low, high))
    matrixsource.write_rows(tools.extract_rows(rows, own, listed), out, template, plan, endian)
    found = sorted(r["cluster"] for r in own.select("cluster").distinct().collect())
    if points:
        slices = tools.reindexed_points(textfiles.read_plain_points(spark, points), own, listed)
        shown = slices.select("cluster", "pos", F.concat_ws("\t", F.col("pos").cast("string"), *(F.col(c).cast("string") for c in "xyz"), F.col("one").cast("string")).alias("value"))
        _write_by_cluster(shown, f"{out}/mds")
    own.unpersist()
    return found


def _write_by_cluster(rows: DataFrame, path: str) -> None:
    """(cluster, pos, value) as a folder for each cluster, whose files follow pos."""
    rows.repartitionByRange("cluster", "pos").sortWithinPartitions("cluster", "pos").select("cluster", "value").write.mode("overwrite").partitionBy("cluster").text(path)


def sub_joins(pattern: str) -> dict[int, dict[int, int]]:
    """cluster -> other -> main of 'c,a+b,d+e|...': sub-clusters of c that are joined."""
    out = {}
    for group in filter(None, pattern.replace('"', "").split("|")):
        c, *joined = group.split(",")
        out[int(c)] = lines.parse_joins("|".join(joined))
    return out


def collate(spark: SparkSession, text: str, overrides: dict[str, str] | None = None, palette: DataFrame | None = None) -> DataFrame:
    """(idx, cluster) of all points, from the points' file with their clusters and a file of sub-clusters for each cluster listed as 'c,planned,found|...'.

    Under outDir: plot lines (outFilePattern), cluster numbers (outLablesFilePattern), a plot of each listed cluster (outsepereateFilesPattern/cluster=c) and the
    elements of the whole plot with their colours (outPlotFilePattern).  Line k of a cluster's file is its k-th point.  Dust stays dust.
    """
    s = config.section(text, config.COLLATE, overrides)
    plan = {int(c): (planned, int(found)) for c, planned, found in (g.split(",") for g in filter(None, s["clusters"].replace('"', "").split("|")))}
    points = textfiles.read_points(spark, f"{s['pointsDir']}/{s['pointFilePattern']}").persist()
    subs = None
    for c, (planned, found) in sorted(plan.items()):
        path = f"{s['clustersDir']}/{s['clusterDirpattern'].replace('{0}', str(c))}/{s['clusterFilePattern'].replace('{0}', planned).replace('{1}', str(found))}"
        one = textfiles.read_assignment(spark, path).select(F.lit(c).alias("cluster"), F.col("idx").cast("long").alias("pos"), F.col("cluster").alias("sub"))
        subs = one if subs is None else subs.unionByName(one)
    subs = spark.createDataFrame([], "cluster int, pos long, sub int") if subs is None else subs
    assign = points.select("idx", "cluster")
    done = tools.collate_planned(assign, subs, {c: k for c, (_, k) in plan.items()}, s["numClusters"], sub_joins(s["join"])).persist()
    out = s["outDir"]
    textfiles.write_lines(tools.plot(points, done), "line", ["idx"], f"{out}/{s['outFilePattern']}")
    textfiles.write_assignment(done, f"{out}/{s['outLablesFilePattern']}")
    place = tools.ordinals(assign.where(F.col("cluster").isin(list(plan)))).withColumnRenamed("cluster", "own")
    each = points.drop("cluster").join(place, "idx").join(done, "idx")
    value = F.concat_ws(" ", F.col("pos").cast("string"), *(F.format_string("%.6f", c) for c in "xyz"), F.col("cluster").cast("string"), F.col("cluster").cast("string"))
    _write_by_cluster(each.select(F.col("own").alias("cluster"), "pos", value.alias("value")), f"{out}/{s['outsepereateFilesPattern']}")
    coloured = tools.cluster_xml(tools.coloured(done, tools.palette(spark) if palette is None else palette)).select(F.lit(0).alias("kind"), "key", "xml")
    shown = tools.plot_xml(points.drop("cluster").join(done, "idx").withColumn("label", F.lit("")))
    textfiles.write_lines(coloured.unionByName(shown.select(F.lit(1).alias("kind"), F.col("idx").cast("int").alias("key"), "xml")), "xml", ["kind", "key"], f"{out}/{s['outPlotFilePattern']}")
    points.unpersist()
    return done


def merge(spark: SparkSession, text: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """The whole matrix of block files as ordered part files (file, first, rows, bytes); a block that lacks is its mirror transposed.

    The diagonal blocks give the sizes of the block rows, which may differ; skipped ranks are left out of rows and columns.  A pair that lacks in both forms, a diagonal
    block that is not square and a block of another size than its row and column raise.  A block is one file and has to fit a task.
    """
    s = config.section(text, config.BLOCK_MERGER, overrides)
    skip = set(lines.skip_ranks(s["skipRanks"]))
    kept = [k for k in range(s["blockCount"]) if k not in skip]
    name = "".join(r"(\d+)" if part in ("{1}", "{2}") else _quoted(part) for part in _cut(s["nameFormat"]))
    row_first = s["nameFormat"].index("{1}") < s["nameFormat"].index("{2}")
    file = F.element_at(F.split("path", "/"), -1)
    at = lambda k: F.regexp_extract(file, f"^{name}$", k).cast("int")
    found = spark.read.format("binaryFile").load(s["blockDir"]).where(file.rlike(f"^{name}$"))
    found = found.withColumn("gi", at(1 if row_first else 2)).withColumn("gj", at(2 if row_first else 1)).where(F.col("gi").isin(kept) & F.col("gj").isin(kept))
    sizes = {r["gi"]: math.isqrt(r["length"] // 2) for r in found.where("gi = gj").select("gi", "length").collect()}
    if lacking := [k for k in kept if k not in sizes]:
        raise ValueError(f"diagonal blocks {lacking} are missing")
    first = dict(zip(kept, np.cumsum([0, *(sizes[k] for k in kept)]).tolist()))
    kind = ">i2" if s["isBigEndian"] else "<i2"

    def decode(batches):
        for b in batches:
            for gi, gj, content in zip(b.column("gi").to_pylist(), b.column("gj").to_pylist(), b.column("content")):
                d = np.frombuffer(content.as_buffer(), np.uint8)
                if len(d) != 2 * sizes[gi] * sizes[gj]:
                    raise ValueError(f"block {gi}, {gj} has {len(d)} bytes instead of {2 * sizes[gi] * sizes[gj]}")
                yield blocks.block(gi, gj, first[gi] + np.arange(sizes[gi]), first[gj] + np.arange(sizes[gj]), d.view(kind))

    whole = blocks.merge(found.select("gi", "gj", "content").mapInArrow(decode, blocks.BLOCK))
    return files.write_matrix(blocks.to_rows(whole), s["outFile"], s["isBigEndian"])


def _cut(name: str) -> list[str]:
    """The name's text and its two marks, in order."""
    if name.count("{1}") != 1 or name.count("{2}") != 1:
        raise ValueError("nameFormat must hold {1} and {2} once each")
    return [y for x in name.replace("{1}", "\0{1}\0").replace("{2}", "\0{2}\0").split("\0") if (y := x)]


def _quoted(part: str) -> str:
    return "".join(x if x.isalnum() or x == "_" else "\\" + x for x in part)
