"""Runs from the command line: ``python -m frostline.cli cluster|centers|extract|collate|merge -c FILE -n NODES -t THREADS``.

``cluster`` anneals the configured matrix and writes labels, a timing line and a summary; ``centers`` finds the representative centers of a cluster file;
``extract``, ``collate`` and ``merge`` run the tools of ``plans.filejobs`` on their sections.
Nodes and threads are only recorded, as the master that Spark was given decides where tasks run.
"""

from __future__ import annotations

import argparse
import datetime
import platform

from pyspark.sql import DataFrame, SparkSession

from .operators import anneal, anneal_tables, blocks, centers
from .plans import filejobs
from .operators.distance import read_matrix, to_long
from .sources import config, files, textfiles


def options(arguments: list[str] | None = None) -> argparse.Namespace:
    """All of c, n and t are required; ``-D key=value`` overrides a key of the file."""
    p = argparse.ArgumentParser(prog="frostline")
    p.add_argument("command", choices=["cluster", "centers", "extract", "collate", "merge"])
    p.add_argument("-c", dest="conf", required=True, help="properties file")
    p.add_argument("-n", dest="nodes", type=int, required=True)
    p.add_argument("-t", dest="threads", type=int, required=True)
    p.add_argument("-D", dest="overrides", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("-m", dest="points", help="extract: file of coordinates to cut by cluster")
    p.add_argument("-s", dest="state", help="folder that keeps the state of a run, to go on after a stop")
    return p.parse_args(arguments)


def cluster(spark: SparkSession, text: str, overrides: dict[str, str], threads: int = 1, nodes: int = 1, state: str | None = None) -> anneal_tables.TableAnnealer:
    """Labels, a timing line and a summary of an anneal; with ``state`` a folder keeps the run, and one that was stopped goes on from there."""
    o, f = config.load(text, overrides)
    n = f.NumberDataPoints
    labels, a = anneal_tables.anneal(blocks.from_rows(read_matrix(spark, f.DistanceMatrixFile, n, f.IsBigEndian, f.Repetitions)), o, folder=state)
    s, t = a.state, a.matrix.timers
    log = [f"{n} points, first temperature {a.initial:.6f}", *a.log]
    stem, _, extension = f.ClusterFile.rpartition(".")
    name = textfiles.cluster_file_name(stem or extension, o.max_clusters, s.k, f".{extension}" if stem else "")
    textfiles.write_assignment(labels, name)
    ms = {k: v * 1000 for k, v in t.seconds.items()}
    record = textfiles.timing_record(t.total * 1e3, t.total * 1e6, threads, 1, nodes, -(-n // max(1, threads * nodes)), n, o.max_clusters, ms["splitting"], ms["reduce"], ms["exchange"], ms["exchange_eigen"], ms["broadcast"], f.DistanceMatrixFile, datetime.datetime.now().isoformat(" ", "seconds"), platform.node())
    textfiles.write_timing(spark, record, f.TimingFile)
    textfiles.write_summary(spark, [*log, *anneal.diagnostics(s), *t.lines()], f.SummaryFile)
    return a


def find_centers(spark: SparkSession, text: str, overrides: dict[str, str]) -> DataFrame:
    """(cluster, rank, line) of the five methods' centers; reads ClusterFile, AddMdsFile, LabelFile and the matrix, and writes CenterPlotFile where it is set."""
    _, f = config.load(text, overrides)
    n = f.NumberDataPoints
    assign = textfiles.read_assignment(spark, f.ClusterFile, n)
    mds = textfiles.read_points(spark, f.AddMdsFile).select("idx", "x", "y", "z")
    labels = textfiles.read_labels(spark, f.LabelFile, 0, n)
    points = assign.join(mds, "idx").join(labels, "idx", "left").persist()
    cells = to_long(read_matrix(spark, f.DistanceMatrixFile, n, f.IsBigEndian, f.Repetitions))
    cuts = centers.Cuts(centers=f.NumberOfCenters)
    pairs = centers.links(cells, points, cuts).persist()
    stats = centers.group_stats(pairs)
    fractions = [float(x) for x in f.BucketFractions.split(",")]
    bucket = centers.by_bucket(pairs, points, centers.radii(centers.distance_histogram(pairs), stats, fractions), cuts)
    mean, coordinate, gravity = centers.by_mean_distance(pairs, points, cuts), centers.by_mds_distance(pairs, points, cuts), centers.by_gravity(points, cuts)
    best = centers.overall_best(centers.ratings(mean, coordinate, gravity, bucket, len(fractions)), cuts.centers)
    tops = {"SmallestDistanceMeans": mean, "SmallestMDSDistanceMeans": coordinate, "SmallestMDSCoG": gravity, "OverallBest": best}
    tops |= {f"LargestCountsBucket-{b}": bucket.where(bucket["bucket"] == b) for b in range(len(fractions))}
    out = None
    for method, top in tops.items():
        lines = centers.center_lines(top, method, points)
        out = lines if out is None else out.unionByName(lines)
    if path := f.CenterOutputFile:
        textfiles.write_lines(textfiles.dated(out), "line", ["cluster", "line"], path)
        averages = centers.averages({"SmallestDistanceMeans": mean}, {"SmallestMDSDistanceMeans": coordinate, "SmallestMDSCoG": gravity}, cells, points)
        textfiles.write_lines(centers.average_lines(averages), "line", ["cluster", "line"], f"{path}.averages")
    return out


def main(arguments: list[str] | None = None) -> None:
    given = options(arguments)
    spark = SparkSession.builder.appName("frostline").getOrCreate()
    text = "\n".join(r["value"] for r in files.numbered_lines(spark, given.conf).orderBy("pos").collect())
    overrides = dict(x.split("=", 1) for x in given.overrides)
    if given.command == "cluster":
        cluster(spark, text, overrides, given.threads, given.nodes, given.state)
    elif given.command == "centers":
        find_centers(spark, text, overrides).count()
    elif given.command == "extract":
        filejobs.extract(spark, text, overrides, given.points)
    elif given.command == "collate":
        filejobs.collate(spark, text, overrides)
    else:
        filejobs.merge(spark, text, overrides)


if __name__ == "__main__":
    main()
