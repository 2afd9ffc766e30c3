"""The binary matrix data source: byte ranges, push-down, files of each cluster, and failed writes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import distance, tools
from frostline.sources import config, matrixsource


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(matrixsource.Int16Matrix)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def square(n, seed=1):
    return np.random.default_rng(seed).integers(-32767, 32767, (n, n)).astype(np.int16)


@pytest.mark.parametrize("endian", ["little", "big"])
def test_rows_of_files_and_folders(source, tmp_path, endian):
    d = square(37)
    kind = ">i2" if endian == "big" else "<i2"
    (tmp_path / "one.bin").write_bytes(d.astype(kind).tobytes())
    folder = tmp_path / "parts"
    folder.mkdir()
    for k, part in enumerate((d[:5], d[5:20], d[20:])):
        (folder / f"part-{k}.bin").write_bytes(part.astype(kind).tobytes())
    for path in (tmp_path / "one.bin", folder):
        read = source.read.format("int16matrix").option("columns", 37).option("endian", endian).option("partition_bytes", 400)
        rows = read.load(str(path)).orderBy("i").collect()
        assert [r["i"] for r in rows] == list(range(37)) and [r["d"] for r in rows] == d.tolist()
        tiled = read.option("repetitions", 2).load(str(path)).where("i between 4 and 6").orderBy("i").collect()
        assert [r["d"] for r in tiled] == np.tile(d[4:7], 2).tolist()


def test_only_the_rows_asked_for_are_read(source, tmp_path):
    (tmp_path / "m.bin").write_bytes(square(50).tobytes())
    reader = matrixsource.MatrixReader({"path": str(tmp_path / "m.bin"), "columns": "50", "partition_bytes": "1000"})
    from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan

    left = list(reader.pushFilters([IsNotNull(("i",)), GreaterThanOrEqual(("i",), 17), LessThan(("i",), 42)]))
    parts = reader.partitions()
    assert len(left) == 1 and parts[0].first == 17 and parts[-1].end == 42 and all(p.end - p.first <= 10 for p in parts)
    got = source.read.format("int16matrix").option("columns", 50).load(str(tmp_path / "m.bin")).where("i >= 17 and i < 42 and i % 2 = 0")
    assert sorted(r["i"] for r in got.collect()) == list(range(18, 42, 2))
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number of rows"):
        source.read.format("int16matrix").option("columns", 50).load(str(tmp_path / "bad.bin")).count()


def test_extracted_clusters_as_files(source, tmp_path):
    d = square(30, 2)
    cells = distance.to_long(source.createDataFrame([(i, r.tolist()) for i, r in enumerate(d)], "i int, d array<short>"))
    assign = source.createDataFrame([(i, i % 4) for i in range(30)], "idx int, cluster int")
    out = tmp_path / "out"
    matrixsource.write_clusters(tools.extract(cells, assign, [1, 3]), str(out), "MaxNcent=9\nTimingFile=t", {1: 2, 3: 4})
    manifest = {c["cluster"]: c for c in json.loads((out / "manifest.json").read_text())}
    assert set(manifest) == {1, 3} and not list(out.glob("_tmp*"))
    for c, k in ((1, 2), (3, 4)):
        own = np.arange(c, 30, 4)
        read = source.read.format("int16matrix").option("columns", len(own)).load(str(out / f"cluster-{c}")).orderBy("i")
        assert [r["d"] for r in read.collect()] == d[np.ix_(own, own)].tolist() and manifest[c]["rows"] == len(own)
        given = config.parse((out / f"cluster-{c}.properties").read_text())
        assert given["NumberDataPoints"] == str(len(own)) and given["MaxNcent"] == str(k) and given["TimingFile"] == "t" and given["DistanceMatrixFile"].endswith(f"cluster-{c}")
    assert config.parse((out / "conf_shared.prop").read_text()) == {"numClusters": "2", "subClusters": "1,2,2|3,4,4|"}
    with pytest.raises(Exception, match="has a matrix already"):
        matrixsource.write_clusters(tools.extract(cells, assign, [1]), str(out))
    assert not list(out.glob("_tmp*")) and len(json.loads((out / "manifest.json").read_text())) == 2


def test_a_failed_write_leaves_nothing(source, tmp_path):
    rows = source.range(40).select((F.col("id") % 2).cast("int").alias("cluster"), F.col("id").cast("int").alias("i"), F.when(F.col("id") == 33, F.raise_error(F.lit("killed"))).otherwise(F.array(F.lit(1).cast("short"))).alias("d"))
    with pytest.raises(Exception):
        rows.repartitionByRange(4, "i").sortWithinPartitions("cluster", "i").write.format("int16matrix").mode("append").save(str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*"))
