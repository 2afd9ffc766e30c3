"""Text files, blocks, configuration and the workflow."""

import warnings

import numpy as np
import pytest
from pyspark.errors import PySparkException

from frostline import cli
from frostline.functions import text
from frostline.operators import anneal, anneal_tables, distance, tools
from frostline.plans import workflow
from frostline.sources import config, files, textfiles


def test_text_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("0 1 2 3 7\n\n1\t4 5 6 8\n2 7 8 9 9\n")
    assert [tuple(r) for r in textfiles.read_points(spark, str(tmp_path / "p.txt"), 1, 1).collect()] == [(1, 4.0, 5.0, 6.0, 8)]
    assert [r["cluster"] for r in textfiles.read_assignment(spark, str(tmp_path / "p.txt"), 3).orderBy("idx").collect()] == [7, 8, 9]
    with pytest.raises(ValueError):
        textfiles.read_assignment(spark, str(tmp_path / "p.txt"), 4)
    (tmp_path / "n.txt").write_text("0 -1\n")
    with pytest.raises(PySparkException):
        textfiles.read_assignment(spark, str(tmp_path / "n.txt")).collect()
    assign = spark.createDataFrame([(2, 1), (0, 5), (1, 4)], "idx int, cluster int")
    textfiles.write_assignment(assign, str(tmp_path / "out"))
    lines = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert lines == "0\t5\n1\t4\n2\t1\n"
    assert textfiles.cluster_file_name("cluster", 8, 4) == "cluster-M8-C4.txt"


def written(path):
    return "".join(f.read_text() for f in sorted(path.glob("part-*")))


def test_timing_and_summary(spark, tmp_path):
    record = textfiles.timing_record(1000.0, 1e6, 2, 3, 4, 10, 240, 8, 123.41, 500.0, 0.0, 1.0, 999.95, "d.bin", "now", "host")
    for _ in range(2):
        textfiles.write_timing(spark, record, str(tmp_path / "timing"))
    lines = written(tmp_path / "timing").splitlines()
    assert sorted(x.count("\t") for x in lines) == [22] * 3 and sum(x.startswith("Duration(ms)\t") for x in lines) == 1
    assert max(lines, key=lambda x: x.startswith("1000")).split("\t")[:20] == "1000 1000000 2 3 4 2x3x4 24 10 240 8 123 0.1235 500 0.5 0 0.0 1 0.001 1000 1.0".split()
    with pytest.raises(ValueError):
        textfiles.write_timing(spark, record[:5], str(tmp_path / "timing"))
    textfiles.write_summary(spark, ["a", "b"], str(tmp_path / "summary"))
    assert written(tmp_path / "summary") == "\na\nb\n"


def test_readers_of_the_tools(spark, tmp_path):
    (tmp_path / "c.txt").write_text("0 3\n1 4\n2 5 6\n3 1\n")
    assert [tuple(r) for r in textfiles.read_cluster_file(spark, str(tmp_path / "c.txt")).orderBy("idx").collect()] == [(0, 3), (1, 4)]
    with pytest.raises(PySparkException):
        textfiles.read_cluster_file(spark, str(tmp_path / "c.txt"), clusters=4).collect()
    (tmp_path / "p.txt").write_text("9 1 2 3\n8 4 5 6\n")
    assert [tuple(r) for r in textfiles.read_plain_points(spark, str(tmp_path / "p.txt")).orderBy("idx").collect()] == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    (tmp_path / "n.txt").write_text("0 7\n0 0 0 0 2\n")
    both = textfiles.read_in_step(spark, str(tmp_path / "p.txt"), str(tmp_path / "n.txt"))
    assert sorted((r["idx"], r["cluster"]) for r in both.collect()) == [(8, 2), (9, 7)] and tuple(textfiles.span(both).first()) == (9, 7, 2)
    (tmp_path / "l.txt").write_text("0 a b 5\n1 c 6\n2 7\n")
    assert [tuple(r) for r in textfiles.read_labels(spark, str(tmp_path / "l.txt"), 1, 2).orderBy("idx").collect()] == [(1, "c", 6), (2, "", 7)]
    with pytest.raises(ValueError):
        textfiles.read_labels(spark, str(tmp_path / "l.txt"), 1, 5)
    (tmp_path / "centers.txt").write_text('PointNumber=3      Measure=0.5 Count=2.5 Source=Both Method=OverallBest Group=1 Sequence=a b c Length=12 Date="x"\nPointNumber=4 Measure=1 Method=M Group=2\n')
    got = [tuple(r) for r in textfiles.read_centers(spark, str(tmp_path / "centers.txt")).orderBy("idx").collect()]
    assert got == [(3, 0.5, 2.5, "Both", "OverallBest", 1, "a b c", 12), (4, 1.0, None, None, "M", 2, None, None)]
    (tmp_path / "palette.xml").write_text('<c A="255" R="1" G="2" B="3"/>\n<x/>\n<c A="255" R="4" G="5" B="6"/>\n')
    assert [tuple(r) for r in textfiles.read_palette(spark, str(tmp_path / "palette.xml")).orderBy("place").collect()] == [(0, 255, 1, 2, 3), (1, 255, 4, 5, 6)]
    info = textfiles.center_info(spark.createDataFrame([(1, 1, 5, 0.25, "M", "n", 9)], "cluster int, rank int, idx int, measure double, method string, name string, length int")).first()["line"]
    assert info == "PointNumber=5\tMeasure=0.25\tMethod=M\tGroup=1\tSequence=n\tLength=9"
    assert text.skip_ranks("3,1, 3") == [1, 3] and text.skip_ranks("") == []


def test_sections_of_the_tools():
    got = config.section("clusters = 1,2\nnumPoints=5\nisBigEndian=true", config.EXTRACTOR, {"numPoints": "6"})
    assert got["clusters"] == "1,2" and got["numPoints"] == 6 and got["isBigEndian"] is True and got["newclusters"] == "1" and len(got) == 9
    assert len(config.COLLATE) == 13 and config.section("", config.BLOCK_MERGER) == config.BLOCK_MERGER
    with pytest.warns(UserWarning, match="unknown"):
        config.section("nothing=1", config.COLLATE)


def planted(n, groups):
    rng = np.random.default_rng(3)
    own = np.arange(n) % groups
    d = np.where(own[:, None] == own[None, :], 0.1, 0.9) + rng.uniform(0, 0.01, (n, n))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    return np.rint(d * 32767).astype(np.int16), own


@pytest.mark.parametrize("big", [False, True])
def test_matrix_files(spark, tmp_path, big):
    d, _ = planted(30, 2)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(d)], "i int, d array<short>")
    parts = files.write_matrix(rows, str(tmp_path / "m"), big, 3).collect()
    assert sum(r["rows"] for r in parts) == 30 and sum(r["bytes"] for r in parts) == 1800 and len(list((tmp_path / "m").glob("part-*"))) == len(parts)
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "m").glob("part-*"))) == d.astype(">i2" if big else "<i2").tobytes()
    assert [r["d"] for r in distance.read_matrix(spark, str(tmp_path / "m"), 30, big).orderBy("i").collect()] == d.tolist()


def test_command_line(spark, tmp_path):
    d, own = planted(90, 2)
    (tmp_path / "d.bin").write_bytes(d.astype("<i2").tobytes())
    (tmp_path / "mds.txt").write_text("".join(f"{i} {own[i] * 9 + i / 100} {i % 7} 0\n" for i in range(90)))
    (tmp_path / "labels.txt").write_text("".join(f"{i} seq {i} {100 + i}\n" for i in range(90)))
    names = {"DistanceMatrixFile": "d.bin", "ClusterFile": "out.txt", "TimingFile": "timing", "SummaryFile": "summary", "AddMdsFile": "mds.txt", "LabelFile": "labels.txt", "CenterOutputFile": "centers"}
    conf = "NumberDataPoints=90\nMaxNcent=2\nIterationAtEnd=60\n" + "".join(f"{k}={tmp_path}/{v}\n" for k, v in names.items())
    with pytest.raises(SystemExit):
        cli.options(["cluster", "-c", "x", "-n", "1"])
    assert cli.options(["cluster", "-c", "x", "-n", "1", "-t", "4", "-D", "A=b"]).overrides == ["A=b"]
    a = cli.cluster(spark, conf, {}, 2, 3)
    out = next(tmp_path.glob("out-M2-C*"))
    labels = dict(map(int, x.split("\t")) for x in written(out).splitlines())
    assert len({(labels[i], own[i]) for i in range(90)}) == 2 and a.matrix.timers.calls["exchange"] > 3
    assert "2x1x3" in written(tmp_path / "timing") and "splitting" in written(tmp_path / "summary")
    got = cli.find_centers(spark, conf, {"ClusterFile": str(out), "NumberOfCenters": "3"})
    lines = [r["line"] for r in got.collect()]
    assert {x.split("Method=")[1].split()[0] for x in lines} >= {"SmallestDistanceMeans", "SmallestMDSDistanceMeans", "SmallestMDSCoG", "OverallBest", "LargestCountsBucket-0"}
    back = textfiles.read_centers(spark, str(tmp_path / "centers"))
    assert back.count() == len(lines) and back.where("length is null").count() == 0
    spectrum = anneal_tables.critical_spectrum(a.matrix)
    m = d / 32767
    c = m - m.mean(axis=0)[None, :] - m.mean(axis=1)[:, None] + m.mean()
    assert np.allclose(spectrum, np.linalg.eigvalsh(c)[[0, -1]], rtol=1e-6)


def test_recluster_with_a_plan(spark):
    """Two groups, one of which has two parts, clustered, then only that one clustered again."""
    rng = np.random.default_rng(5)
    part = np.repeat([0, 1, 2], 40)
    base = np.array([[0.05, 0.4, 0.9], [0.4, 0.05, 0.9], [0.9, 0.9, 0.05]])
    d = base[part][:, part] + rng.uniform(0, 0.01, (120, 120))
    d = np.rint((d + d.T) / 2 * 32767).astype(np.int16)
    np.fill_diagonal(d, 0)
    cells = distance.to_long(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(d)], "i int, d array<short>"))
    cells = cells.select("i", "j", "d")
    first = spark.createDataFrame([(i, int(part[i] == 2)) for i in range(120)], "idx int, cluster int")
    out = workflow.recluster(cells, first, {}, {0: 2}, anneal.Options(iteration_at_end=60))
    got = {r["idx"]: r["cluster"] for r in out.collect()}
    assert len(set(got.values())) == 3 and all(len({got[i] for i in range(120) if part[i] == k}) == 1 for k in range(3))


def test_blocks_on_disk(spark, tmp_path):
    d = np.arange(16).reshape(4, 4).astype(np.int16)
    d = d + d.T
    for i, j in ((0, 0), (0, 1), (1, 1)):
        (tmp_path / f"{i}_{j}.bin").write_bytes(d[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].astype("<i2").tobytes())
    got = tools.merge_blocks(textfiles.read_blocks(spark, str(tmp_path / "*.bin"), 2, r"(\d+)_(\d+)\.bin"), 2)
    rows = distance.to_rows(got).orderBy("i").collect()
    assert [r["d"] for r in rows] == d.tolist()


def test_config():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        options, files = config.load("# a\nMaxNcent = 4\nContinuousClustering=true\nTransformDimension=4\nNumberDataPoints: 12\nOdd=1\n", {"MaxNcent": "6"})
    assert options == anneal.Options(max_clusters=6, continuous=True) and files.NumberDataPoints == 12
    assert len(seen) == 2
    assert config.parse(config.dump({"IsBigEndian": False, "NumberDataPoints": 3})) == {"IsBigEndian": "false", "NumberDataPoints": "3"}


def test_recluster_without_a_plan(spark):
    assign = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "idx int, cluster int")
    cells = spark.createDataFrame([(0, 0, 0)], "i int, j int, d int")
    got = workflow.recluster(cells, assign, {2: 0}, {}, anneal.Options())
    assert {r["idx"]: r["cluster"] for r in got.collect()} == {0: 0, 1: 1, 2: 0}
