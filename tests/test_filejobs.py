"""Runs of the tools from configuration sections to files, read back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline import cli
from frostline.operators import centers, tools
from frostline.plans import filejobs
from frostline.sources import config, textfiles


def written(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def matrix(n, seed=1):
    return np.random.default_rng(seed).integers(-32767, 32767, (n, n)).astype(np.int16)


@pytest.mark.parametrize("endian", ["little", "big"])
def test_extract_to_files(spark, tmp_path, endian):
    d, kind = matrix(40), ">i2" if endian == "big" else "<i2"
    (tmp_path / "d.bin").write_bytes(d.astype(kind).tobytes())
    own = [k % 5 for k in range(40)]
    (tmp_path / "c.txt").write_text("".join(f"{k}\t{c}\n" for k, c in enumerate(own)))
    (tmp_path / "p.txt").write_text("".join(f"{k} {k}.5 {-k}.25 1.0\n" for k in range(40)))
    text = f"clusterFile={tmp_path}/c.txt\ndistFile={tmp_path}/d.bin\nnumPoints=40\noutDir={tmp_path}/out\nisBigEndian={str(endian == 'big').lower()}\nclusters=3,1,7\nnewclusters=4,2\njoins=1+4|3\n"
    assert filejobs.extract(spark, text, points=f"{tmp_path}/p.txt", template="MaxNcent=9\nTimingFile=t") == [1, 3]
    manifest = {c["cluster"]: c["rows"] for c in json.loads((tmp_path / "out/manifest.json").read_text())}
    assert manifest == {1: 16, 3: 8}
    for c, k, members in ((1, 2, {1, 4}), (3, 4, {3})):
        ids = [x for x in range(40) if own[x] in members]
        folder = tmp_path / f"out/cluster-{c}"
        assert b"".join(p.read_bytes() for p in sorted(folder.glob("part-*.bin"))) == d[np.ix_(ids, ids)].astype(kind).tobytes()
        given = config.parse((tmp_path / f"out/cluster-{c}.properties").read_text())
        assert given["NumberDataPoints"] == str(len(ids)) and given["MaxNcent"] == str(k) and given["TimingFile"] == "t"
        assert written(tmp_path / f"out/mds/cluster={c}") == "".join(f"{at}\t{x}.5\t{-x}.25\t1.0\t1\n" for at, x in enumerate(ids))
    assert config.parse((tmp_path / "out/conf_shared.prop").read_text())["subClusters"] == "1,2,2|3,4,4|"
    with pytest.raises(ValueError, match="must list"):
        filejobs.extract(spark, text, {"clusters": "None"})
    with pytest.raises(ValueError, match="no listed cluster"):
        filejobs.extract(spark, text, {"clusters": "77"})


def test_a_point_outside_the_matrix_raises(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "i int, d array<short>")
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        tools.extract_rows(rows, spark.createDataFrame([(0, 0), (2, 0)], "idx int, cluster int"), [0]).collect()


def test_collate_to_files(spark, tmp_path):
    own = [0, 1, 2, 1, 1, tools.DUST, 2, 1, 0]
    (tmp_path / "points.txt").write_text("".join(f"{k} {k} 0.5 -1 {c}\n" for k, c in enumerate(own)))
    (tmp_path / "1").mkdir()
    (tmp_path / "1/own-M4-C3.txt").write_text("0\t2\n1\t0\n2\t1\n3\t2\n")
    (tmp_path / "2").mkdir()
    (tmp_path / "2/own-M2-C2.txt").write_text("0\t1\n1\t1\n")
    text = "\n".join(f"{k}={v}" for k, v in {"pointsDir": tmp_path, "pointFilePattern": "points.txt", "clustersDir": tmp_path, "clusterDirpattern": "{0}", "clusterFilePattern": "own-M{0}-C{1}.txt", "outDir": f"{tmp_path}/out", "outFilePattern": "plot", "outPlotFilePattern": "xml", "outLablesFilePattern": "labels", "outsepereateFilesPattern": "each", "numClusters": 4, "join": "1,0+1|", "clusters": '"1,4,3|2,2,2|"'}.items())
    filejobs.collate(spark, text)
    # cluster 0 is 0; 1 has 0, 0 (joined) and 1, thus 1, 1, 2; 2 has 3 (without points) and 4; 3 is 5
    want = [0, 2, 4, 1, 1, tools.DUST, 4, 2, 0]
    assert written(tmp_path / "out/labels") == "".join(f"{k}\t{c}\n" for k, c in enumerate(want))
    label = lambda c: "Dust" if c == tools.DUST else c
    assert written(tmp_path / "out/plot") == "".join(f"{k} {k:.6f} 0.500000 -1.000000 {c} {label(c)}\n" for k, c in enumerate(want))
    assert written(tmp_path / "out/each/cluster=1").splitlines() == [f"{at} {k:.6f} 0.500000 -1.000000 {want[k]} {want[k]}" for at, k in enumerate((1, 3, 4, 7))]
    assert sorted(p.name for p in (tmp_path / "out/each").glob("cluster=*")) == ["cluster=1", "cluster=2"]
    xml = written(tmp_path / "out/xml").splitlines()
    assert len(xml) == 5 + 9 and all(x.startswith("<cluster>") for x in xml[:5]) and "<key>0</key><clusterkey>0</clusterkey>" in xml[5] and "<label>Dust</label>" in xml[4]
    with pytest.raises(Exception, match="no declared sub-cluster"):
        filejobs.collate(spark, text, {"clusters": "1,4,3|2,2,1|", "clusterFilePattern": "own-M{0}-C{1}.txt", "outDir": f"{tmp_path}/again", "clusterDirpattern": "{0}"} | ((tmp_path / "2/own-M2-C1.txt").write_text("0\t1\n1\t1\n") and {}))
    with pytest.raises(ValueError, match="joined to none"):
        tools.collate_planned(spark.createDataFrame([], "idx int, cluster int"), spark.createDataFrame([], "cluster int, pos long, sub int"), {0: 2}, 1, {0: {1: 5}})


@pytest.mark.parametrize("endian", ["little", "big"])
def test_merge_to_a_file(spark, tmp_path, endian):
    kind, cut = ">i2" if endian == "big" else "<i2", [0, 4, 7, 9, 14]
    d = np.triu(matrix(14, 3))
    d = (d + np.triu(d, 1).T).astype(np.int16)
    (tmp_path / "in").mkdir()
    for a in range(4):
        for b in range(4):
            if (a + b) % 2 == 0 or a < b:
                (tmp_path / f"in/x.{b}-{a}.bin").write_bytes(d[cut[a] : cut[a + 1], cut[b] : cut[b + 1]].astype(kind).tobytes())
    text = f"blockDir={tmp_path}/in\nnameFormat=x.{{2}}-{{1}}.bin\nblockCount=4\noutFile={tmp_path}/all\nskipRanks=2\nisBigEndian={str(endian == 'big').lower()}"
    parts = filejobs.merge(spark, text)
    kept = np.r_[0:7, 9:14]
    assert parts.agg(F.sum("rows")).first()[0] == 12
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "all").glob("part-*.bin"))) == d[np.ix_(kept, kept)].astype(kind).tobytes()
    (tmp_path / "in/x.1-0.bin").unlink()
    with pytest.raises(ValueError, match="missing in both forms"):
        filejobs.merge(spark, text, {"outFile": f"{tmp_path}/b"})
    (tmp_path / "in/x.1-1.bin").unlink()
    with pytest.raises(ValueError, match="diagonal blocks"):
        filejobs.merge(spark, text, {"outFile": f"{tmp_path}/c"})
    (tmp_path / "in/x.1-1.bin").write_bytes(b"\0" * 18)
    (tmp_path / "in/x.1-0.bin").write_bytes(b"\0" * 20)
    with pytest.raises(Exception, match="bytes instead of"):
        filejobs.merge(spark, text, {"outFile": f"{tmp_path}/d"})


def test_runs_from_the_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0-0.bin").write_bytes(matrix(3).tobytes())
    (tmp_path / "c.properties").write_text(f"blockDir={tmp_path}/in\nblockCount=1\noutFile=nowhere\n")
    cli.main(["merge", "-c", f"{tmp_path}/c.properties", "-n", "1", "-t", "1", "-D", f"outFile={tmp_path}/all"])
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "all").glob("part-*.bin"))) == matrix(3).tobytes()


def test_averages_of_centers(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 3.0, 4.0, 0.0), (2, 0.0, 0.0, 12.0), (3, 1.0, 1.0, 1.0)], "idx int, x double, y double, z double")
    top = spark.createDataFrame([(0, 1, 1), (0, 0, 2), (0, 2, 3)], "cluster int, idx int, rank int")
    cells = spark.createDataFrame([(a, b, 32767 * (a + b) // 10) for a in range(3) for b in range(3)], "i int, j int, d int")
    got = {(r["method"], r["idx"]): (round(r["mean_other"], 4), round(r["to_top"], 4)) for r in centers.averages({"M": top}, {"C": top}, cells, points).collect()}
    assert got == {("C", 0): (8.5, 5.0), ("C", 1): (9.0, 0.0), ("C", 2): (12.5, 13.0), ("M", 0): (0.15, 0.1), ("M", 1): (0.2, 0.0), ("M", 2): (0.25, 0.3)}
    assert len(textfiles.TIMING) == 23


def test_palette_and_clusters(spark):
    colours = tools.palette(spark, 7)
    assert colours.distinct().count() == 7 and colours.where("r between 0 and 255 and g between 0 and 255 and b between 0 and 255").count() == 7
    got = {r["key"]: (r["r"], r["g"], r["b"], r["label"]) for r in tools.coloured(spark.createDataFrame([(k, c) for k, c in enumerate((0, 8, 8, 15, tools.DUST))], "idx int, cluster int"), colours).collect()}
    assert set(got) == {0, 8, 15, tools.DUST} and got[8][:3] == got[15][:3] != got[0][:3] and got[tools.DUST][3] == "Dust" and got[8][3] == "8"
