"""Sums over distances that are made block by block and not kept, against the whole matrix; ids have gaps, blocks and packs are cut inside the data."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import frostline.catalog as catalog
from frostline.operators import blocks, distance, em, spectrum
from test_tables import cloud, matrix

SF = "/root/testdata/sf0.001"
IDS = np.arange(-90, 90, 3)
X = cloud(1, 60, 3)
D = matrix(X).astype(np.int64)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(IDS, X)], "idx int, vector array<double>")


def test_sums_by_group(spark, vectors):
    group = np.arange(60) % 40  # more groups than a product takes in some blocks
    for g in (group, group % 3):
        for side in (16, 60):
            got = {(r["idx"], r["k"]): r["s"] for r in blocks.group_sums(vectors, spark.createDataFrame([(int(i), int(k)) for i, k in zip(IDS[1:], g[1:])], "idx int, cluster int"), side).collect()}
            of = np.where(np.arange(60) > 0, g, -1)  # the first point has no group: no column, but a row
            assert got == {(int(IDS[i]), int(k)): int(D[i, of == k].sum()) for i in range(60) for k in set(of[1:].tolist())}


def test_row_sums_are_exact_for_both_float_types(spark, vectors):
    got = {r["idx"]: (r["s"], r["n"]) for r in blocks.row_sums(vectors, 16).collect()}
    assert got == {int(i): (int(s), 60) for i, s in zip(IDS, D.sum(axis=1))}
    narrow = vectors.selectExpr("idx", "cast(vector AS array<float>) AS vector")
    want = matrix(X.astype(np.float32).astype(float)).astype(np.int64).sum(axis=1)
    assert [r["s"] for r in blocks.row_sums(narrow, 16).orderBy("idx").collect()] == want.tolist()


def test_moments_symmetry_and_soft_sums(spark, vectors):
    r = distance.temperature_of(blocks.moments(vectors, 16)).first()
    off = D[~np.eye(60, dtype=bool)] / 32767
    assert r["n"] == 60 * 59 and np.isclose(r["mean"], off.mean()) and np.isclose(r["std"], off.std())
    assert blocks.unequal(vectors, 16).agg({"bad": "sum"}).first()[0] == 0
    m = np.random.default_rng(0).random((60, 2))
    rows = spark.createDataFrame([(int(i), k, float(m[at, c])) for at, i in enumerate(IDS) for c, k in enumerate((4, 9))], "idx int, k int, m double")
    got = {(r["idx"], r["k"]): r["b"] for r in em.soft_b_of(vectors, rows).collect()}
    b = D @ m / m.sum(axis=0) / 32767
    assert all(np.isclose(got[int(i), k], b[at, c]) for at, i in enumerate(IDS) for c, k in enumerate((4, 9))) and len(got) == 120


def test_squares_beyond_64_bits(spark):
    rows = spark.createDataFrame([(1 << 40, 1 << 50, 7 << 60)] * 4, "n long, s long, q long")
    assert distance.temperature_of(rows).first()["n"] == 1 << 42


def test_power_step_equals_that_of_cells(spark, vectors):
    v = spectrum.start_vector(vectors.select("idx"), 60)
    want = {r["idx"]: r["y"] for r in spectrum.power_step(spectrum.centred(distance.from_vectors(vectors)), v, 60, 0.02).collect()}
    got = {r["idx"]: r["y"] for r in spectrum.power_step_of(vectors, v, 60, 0.02).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[i], want[i], atol=1e-9) for i in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["q10_hard_b", "q17_soft_b_a_eps", "q20_centered_matrix", "q21_power_step", "q23_split_norms"])
def test_no_query_keeps_the_matrix(spark, name):
    spark.catalog.clearCache()
    made = catalog.QUERIES[name](spark, SF)
    assert "InMemoryTableScan" not in made._jdf.queryExecution().toString()


def test_center_sums_and_extraction_equal_those_of_pairs(spark, vectors):
    from frostline.operators import centers as c, tools

    rng = np.random.default_rng(3)
    rows = [(int(i), at % 3 if at else None, None if at % 7 == 0 else int(rng.integers(100, 500)), *rng.random(3).tolist()) for at, i in enumerate(IDS)]
    points = spark.createDataFrame(rows, "idx int, cluster int, length int, x double, y double, z double").persist()
    cells = distance.from_vectors(vectors).persist()
    flat = lambda df: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}
    for cuts in (c.Cuts(), c.Cuts(min_distance=0.3, length_a=200, length_b=300)):
        pairs = c.links(cells, points, cuts)
        assert flat(c.counted_stats(c.distance_counts(vectors, points, cuts))) == flat(c.group_stats(pairs))
        assert flat(c.summed_mds_mean(c.point_sums(vectors, points, cuts))) == flat(c.mds_group_mean(pairs))
    want = flat(tools.extract(cells, points.select("idx", "cluster"), [0, 1], {2: 0}).select("cluster", "i", "j", "d"))
    got = tools.extract_vectors(vectors, points.select("idx", "cluster"), [0, 1], {2: 0}).select("cluster", "i", "j", "d")
    assert flat(got) == want and got.count() == len(want)
    points.unpersist(), cells.unpersist()


def test_packs_follow_the_tasks_and_pairs_are_dealt_evenly(spark):
    """Twice the vectors are shipped as often as before, each pair alone in its partition; results stay those of the dense matrix."""
    wide = lambda n: spark.range(n, numPartitions=4).select(F.col("id").cast("int").alias("idx"), F.array_repeat(F.lit(0.03125).cast("float"), 1024).alias("vector"))
    assert blocks.vector_packs(wide(3000), side=1)[0].count() == blocks.vector_packs(wide(6000), side=1)[0].count()
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "idx int, part int, vector array<double>")
    for half in (True, False):
        pairs, _ = blocks.vector_pairs(rows, side=4, half=half)
        met = pairs.select(F.spark_partition_id().alias("at"), "part", "p", "q").distinct().groupBy("at").count().collect()
        packs = blocks.vector_packs(rows, side=4)[0].count() // 3
        assert len(met) == 3 * (packs * (packs + 1) // 2 if half else packs**2) and {r["count"] for r in met} == {1}
    got = np.zeros(300)
    for r in blocks.row_sums(rows, side=4).collect():
        got[r["idx"]] = r["s"]
    own = np.arange(300) % 3
    d = np.rint(32767 * (1 - x @ x.T) / 2) * (own[:, None] == own)
    assert (got == d.sum(axis=1)).all()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_rows_are_not_put_together_to_be_cut(spark):
    """q93 groups no slices: the only shuffles are those of packs and of the points' places."""
    made = plan(catalog.QUERIES["q93_extract_rows"](spark, SF))
    assert "collect_list" not in made and "Generate posexplode" not in made


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["q56_histogram", "q54_mds_mean_topk", "q51_min_mean_topk", "q58_bucket_topk", "q61_center_center_avg", "q60_overall_best", "q59_ratings", "q63_center_coordinate_avg", "q85_center_lines", "q57_bucket_radius"])
def test_no_center_query_makes_pairs(spark, monkeypatch, name):
    from frostline.operators import centers as c
    from frostline.plans import inputs

    def pairs(*_):
        raise AssertionError(f"{name} makes pairs of all points")

    monkeypatch.setattr(c, "links", pairs)
    monkeypatch.setattr(inputs, "cells", pairs)
    spark.catalog.clearCache()
    made = catalog.QUERIES[name](spark, SF)
    assert "InMemoryTableScan" not in made._jdf.queryExecution().toString() and made.limit(1).count() == 1


@pytest.mark.parametrize("cut", [{}, {"min_distance": 0.3, "length_a": 200, "length_b": 300}], ids=str)
def test_centers_of_sums_equal_those_of_pairs(spark, vectors, cut):
    """Ids with gaps, a repeated one, a point without a cluster, some without a length, and a cluster of one point."""
    from frostline.operators import centers as c

    rng, cuts = np.random.default_rng(4), c.Cuts(**cut)
    rows = [(int(i), 7 if at == 5 else at % 3 if at else None, None if at % 7 == 0 else int(rng.integers(100, 500)), *rng.random(3).tolist()) for at, i in enumerate(IDS)]
    points = spark.createDataFrame([*rows, (*rows[9][:2], 400, *rows[9][3:])], "idx int, cluster int, length int, x double, y double, z double").persist()
    cells = distance.from_vectors(vectors).persist()
    pairs = c.links(cells, points, cuts).persist()
    flat = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    sums, counts = c.point_sums(vectors, points, cuts), c.distance_counts(vectors, points, cuts)
    mean = c.by_mean_distance(pairs, points, cuts)
    assert flat(c.summed_mean_distance(sums, points, cuts)) == flat(mean)
    assert flat(c.summed_mds_distance(sums, points, cuts)) == flat(c.by_mds_distance(pairs, points, cuts))
    assert flat(c.counted_histogram(counts)) == flat(c.distance_histogram(pairs))
    radius = c.radii(c.counted_histogram(counts), c.counted_stats(counts), [0.15, 0.4, 0.75])
    assert flat(radius) == flat(c.radii(c.distance_histogram(pairs), c.group_stats(pairs), [0.15, 0.4, 0.75]))
    assert flat(c.counted_bucket(c.near_counts(vectors, points, radius, cuts), points, cuts)) == flat(c.by_bucket(pairs, points, radius, cuts))
    assert flat(c.center_distances(mean, c.center_cells(mean, vectors))) == flat(c.center_distances(mean, cells))
    none = points.where("cluster = 7")
    assert not c.near_counts(vectors, none, c.radii(c.counted_histogram(c.distance_counts(vectors, none, cuts)), c.counted_stats(c.distance_counts(vectors, none, cuts)), [0.5]), cuts).count()
    points.unpersist(), cells.unpersist(), pairs.unpersist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_merged_half_joins_nothing_to_its_blocks(spark):
    """q78 makes each block of its half once, where it is turned, and neither joins nor shuffles blocks."""
    made = catalog.QUERIES["q78_block_merge"](spark, SF)
    assert "LeftOuter" not in plan(made) and "LeftAnti" not in plan(made) and plan(made).count("MapInArrow") == 3


def test_half_of_the_blocks_and_their_numbers(spark, vectors):
    half, numbers = blocks.half_blocks(vectors, 16)
    cut = lambda df: sorted((r["gi"], r["gj"], bytes(r["i"]), bytes(r["j"]), bytes(r["d"])) for r in df.collect())
    assert cut(half) == cut(blocks.distance_blocks(vectors, 16).where("gi <= gj"))
    assert {tuple(r) for r in numbers.collect()} == {(r["gi"], r["gj"]) for r in half.collect()}
    whole = cut(blocks.distance_blocks(vectors, 16).where("gi <> 1 and gj <> 1"))
    assert cut(blocks.merge(half, [1], numbers)) == cut(blocks.merge(half, [1])) == whole
    both = half.unionByName(blocks.distance_blocks(vectors, 16).where("gi = 2 and gj = 0"))  # one pair in both forms, the others in one
    assert cut(blocks.merge(both, [1])) == whole
    with pytest.raises(ValueError, match="missing"):
        blocks.merge(half, [1], numbers.where("not (gi = 0 and gj = 3)"))
