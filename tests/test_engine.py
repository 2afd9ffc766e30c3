"""Operators on small fixtures: matrices, annealing, tools and parsers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.functions import text
from frostline.operators import anneal, distance, em, partition, spectrum, tools


def blocks(sizes, within=0.1, between=0.9):
    """Planted groups with a little index-based jitter."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    d = np.where(group[:, None] == group[None, :], within, between)
    i = np.arange(len(group))
    d = d + 0.01 * np.abs(np.sin(i[:, None] * 1.7 + i[None, :] * 1.7))
    np.fill_diagonal(d, 0)
    return np.rint(d * 32767).astype(np.int16), group


def matrix(spark, d):
    rows = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(d)], "i int, d array<short>")
    return anneal.Matrix(rows, len(d))


class Dense:
    """The matrix's interface without Spark, for the loop's logic."""

    def __init__(self, d):
        self.d, self.n = d / 32767, len(d)

    def times(self, x):
        return self.d @ x


def test_matrix_product(spark, monkeypatch):
    d, _ = blocks([4, 5])
    x = np.random.default_rng(0).random((9, 3))
    mat = matrix(spark, d)
    assert np.allclose(mat.times(x), d / 32767 @ x) and np.allclose(mat.times(x[:, 0]), d / 32767 @ x[:, 0])
    monkeypatch.setattr(anneal, "CHUNK_BYTES", 8 * 3 * 4)  # chunks of four rows
    assert np.allclose(mat.times(x), d / 32767 @ x)


def test_binary_round_trip(spark, tmp_path):
    d = (np.arange(36).reshape(6, 6) * 101 - 1500).astype(np.int16)
    for big in (False, True):
        path = tmp_path / f"m{big}.bin"
        path.write_bytes(d.astype(">i2" if big else "<i2").tobytes())
        rows = distance.read_matrix(spark, str(path), 6, big)
        assert [r["d"] for r in rows.orderBy("i").collect()] == d.tolist()
        assert b"".join(bytes(r["payload"]) for r in distance.encode_rows(rows, big).orderBy("i").collect()) == path.read_bytes()
    assert [len(r["d"]) for r in distance.read_matrix(spark, str(path), 6, True, repetitions=2).collect()] == [12] * 6


def test_em_pass_equals_dense_numpy():
    d, _ = blocks([4, 5])
    dd = d / 32767
    rng = np.random.default_rng(1)
    eps = rng.random((9, 3))
    s = anneal.em_pass(Dense(d), anneal.State(eps, 0.2, first=False), anneal.Options())
    m = np.exp(-eps / 0.2)
    m /= m.sum(axis=1, keepdims=True)
    c = m.sum(axis=0)
    b = dd @ m / c
    a = -0.5 * (b * m).sum(axis=0) / c
    assert np.allclose(s.eps, b + a) and np.allclose(s.m.sum(axis=1), 1) and np.isclose(s.c.sum(), 9)
    assert np.isclose(anneal.energy(s), (-2 * a * c).sum())


def literal(dd, s, factor, k, v):
    """The operator on one cluster, element by element."""
    n = len(dd)
    out = np.zeros(n)
    for x in range(n):
        for y in range(n):
            term = -2 * s.a[k] - s.b[y, k] - s.b[x, k] + dd[x, y]
            e = s.m[x, k] * s.m[y, k] * factor**2 / s.t * term / (s.c[k] * factor)
            if x == y:
                e += s.m[x, k] * factor
            out[x] += e * v[y]
    return out


def literal_cross(dd, s, v):
    n, k = v.shape
    out = np.zeros_like(v)
    for x in range(n):
        for mu in range(k):
            for y in range(n):
                for la in range(k):
                    e = sum((s.m[x, c] - (c == mu)) * (s.m[y, c] - (c == la)) * (-2 * s.a[c] - s.b[y, c] - s.b[x, c] + dd[x, y]) / s.c[c] for c in range(k)) * s.m[x, mu] * s.m[y, la] / s.t
                    if x == y:
                        e += s.m[x, mu] * (mu == la) - s.m[x, mu] * s.m[x, la]
                    out[x, mu] += e * v[y, la]
    return out


def test_derivative_products():
    d, _ = blocks([3, 4])
    mat = Dense(d)
    s = anneal.em_pass(mat, anneal.State(np.random.default_rng(2).random((7, 2)), 0.3, first=False), anneal.Options())
    v = np.random.default_rng(3).random((7, 2))
    for factor in (0.5, 1.0):
        got = anneal.derivative_times(mat, s, v, factor)
        for k in range(2):
            assert np.allclose(got[:, k], literal(d / 32767, s, factor, k, v[:, k]))
    assert np.allclose(anneal.cross_derivative_times(mat, s, v), literal_cross(d / 32767, s, v))
    for k in range(2):
        alone = np.where(np.arange(2) == k, v, 0)
        assert np.allclose(anneal.block_derivative_times(mat, s, v)[:, k], literal_cross(d / 32767, s, alone)[:, k])


def test_full_eigenvalues_equal_the_dense_spectrum():
    d, _ = blocks([6, 7])
    mat, n, k = Dense(d), 13, 2
    s = anneal.em_pass(mat, anneal.State(np.random.default_rng(5).random((n, k)), 0.5, first=False), anneal.Options())
    full = np.column_stack([literal_cross(d / 32767, s, x.reshape(n, k)).ravel() for x in np.eye(n * k)])
    found = np.linalg.eigvalsh(full)
    want = found[np.abs(found) > 1e-9]  # moving a point's energies alike changes nothing: n zeros
    assert len(want) == n * (k - 1)
    e = anneal.full_eigenvalues(mat, s, anneal.Options(eigenvalue_change=1e-9, eigenvector_change=1e-9, power_limit=3000))
    assert np.allclose(full, full.T) and abs(e.least[0] - want[0]) < 1e-3 and e.vector.shape == (n, k)
    assert abs(e.largest[0] - want[-1]) < 1e-3


def test_first_split_follows_the_critical_temperature():
    x = np.random.default_rng(4).standard_normal((30, 2)) * [3, 1]
    dd = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    dd = dd / dd.max() * 0.9
    d = np.rint(dd * 32767).astype(np.int16)
    n = len(d)
    j = np.eye(n) - 1 / n
    kappa = np.linalg.eigvalsh(-j @ (d / 32767) @ j / n).max()
    mat = Dense(d)
    o = anneal.Options(eigenvalue_change=1e-7, eigenvector_change=1e-7, power_limit=400)
    for t in (kappa * 1.3, kappa * 0.7):
        s = anneal.em_pass(mat, anneal.State(np.zeros((n, 1)), t), o)
        e = anneal.eigenvalues(mat, s, 0.5, o, [0])
        assert np.isclose(e.least[0], 0.5 * (1 - kappa / t), atol=1e-3)
        assert np.isclose(e.largest[0], 0.5, atol=1e-3)


@pytest.mark.parametrize("options", [{}, {"continuous": True}, {"converge_intermediate": True}])
def test_anneal_recovers_planted_groups(options):
    d, group = blocks([40, 40, 40])
    a = anneal.Annealer(Dense(d), anneal.Options(max_clusters=3, **options))
    s = a.run()
    labels = a.labels(s)
    assert len(set(zip(group.tolist(), labels.tolist()))) == 3 == len(set(labels.tolist()))
    assert (s.f <= a.options.freezing_limit).all() and np.allclose(s.m.sum(axis=1), 1)
    assert len(a.intermediate) == (1 if options.get("converge_intermediate") else 0)


@pytest.mark.parametrize("method", [1, 2, 3, 4])
def test_split_methods(method):
    d, group = blocks([40, 40, 40])
    a = anneal.Annealer(Dense(d), anneal.Options(max_clusters=3, split_method=method, jiggle=0.01, jiggle_along=method == 2))
    labels = a.labels(a.run())
    assert len(set(zip(group.tolist(), labels.tolist()))) == 3 == len(set(labels.tolist()))


def test_split_method_0_never_splits():
    d, _ = blocks([40, 40])
    a = anneal.Annealer(Dense(d), anneal.Options(max_clusters=2, split_method=0, iteration_at_end=20))
    assert a.run().k == 1
    eps = np.arange(6.0).reshape(3, 2)
    assert np.isclose(np.sqrt(((anneal.jiggled(eps, 1.0, np.ones((3, 2)) * 7) - eps) ** 2).mean()), eps.std() / 100)


def test_too_small_groups_are_removed():
    d, _ = blocks([50, 50, 10])
    a = anneal.Annealer(Dense(d), anneal.Options(max_clusters=3))
    assert a.run().k == 2 and any("removed" in x for x in a.log)


def test_small_cluster_is_removed():
    a = anneal.Annealer.__new__(anneal.Annealer)
    s = anneal.State(np.arange(12.0).reshape(4, 3), 0.1)
    assert a.drop(s, 1).eps.tolist() == np.arange(12.0).reshape(4, 3)[:, [0, 2]].tolist()


def test_softmax_and_ties(spark):
    eps = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 1.0)], "idx int, k int, eps double")
    m = {(r["idx"], r["k"]): r["m"] for r in em.softmax(eps, 0.5).collect()}
    assert m[0, 0] == m[0, 1] == 0.5 and np.isclose(m[1, 1], 1 / (1 + np.exp(-2)))
    assert {r["idx"]: r["cluster"] for r in em.relabel(eps).collect()} == {0: 0, 1: 1}


def test_partitions(spark):
    parts = [tuple(r) for r in partition.even(spark, 10, 4).orderBy("part").collect()]
    assert parts == [(0, 0, 3), (1, 3, 3), (2, 6, 2), (3, 8, 2)]
    assert [r["len"] for r in partition.by_length(spark, 10, 4).orderBy("part").collect()] == [4, 4, 2]
    row = spark.range(1).select(partition.intersection(F.lit(1), F.lit(5), F.lit(4), F.lit(9)).alias("x"), partition.intersection(F.lit(1), F.lit(2), F.lit(4), F.lit(9)).alias("y")).first()
    assert tuple(row["x"]) == (4, 5) and row["y"] is None


def test_join_clusters(spark):
    a = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 5), (4, tools.DUST)], "idx int, cluster int")
    assert {r["idx"]: r["cluster"] for r in tools.join_clusters(a, {2: 0}).collect()} == {0: 0, 1: 1, 2: 0, 3: 2, 4: tools.DUST}
    assert tools.join_map({1: 2, 2: 3}) == {1: 3, 2: 3}
    with pytest.raises(ValueError):
        tools.join_map({1: 2, 2: 1})


def test_merge_blocks_takes_the_mirror(spark):
    d = np.arange(16).reshape(4, 4)
    d = d + d.T
    cells = [(i // 2, j // 2, i % 2, j % 2, int(d[i, j])) for i in range(4) for j in range(4) if i // 2 <= j // 2]
    got = tools.merge_blocks(spark.createDataFrame(cells, "bi int, bj int, r int, c int, d int"), 2)
    assert {(r["i"], r["j"]): r["d"] for r in got.collect()} == {(i, j): int(d[i, j]) for i in range(4) for j in range(4)}


def test_label_lines(spark):
    lines = spark.createDataFrame([("3 120",), ("4\tabc 99",), ("5 a b c 7",), ("",)], "line string")
    got = [r["l"] and tuple(r["l"]) for r in lines.select(text.label_line(F.col("line")).alias("l")).collect()]
    assert got == [(3, "", 120), (4, "abc", 99), (5, "a b c", 7), None]
    assert text.parse_joins("0+2|4+5+7|") == {2: 0, 5: 4, 7: 4}


def test_centred_matrix_has_zero_means(spark):
    d, _ = blocks([3, 3])
    cells = distance.to_long(spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(d)], "i int, d array<short>"))
    means = spectrum.centred(cells).groupBy("i").agg(F.sum("c").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-9 for r in means)
    assert distance.asymmetric(cells).first()["bad_pairs"] == 0


def test_numbers_are_printed_like_c(spark):
    from frostline.functions import text

    values = [1125.0, 1135.0, 0.125, 1.005, 2.5e-7, 0.0, -1125.0, 0.0005, 1e100, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = rows.select("i", text.scientific(rows.v, 2).alias("e"), text.fixed(rows.v, 3).alias("f"), text.fixed(rows.v, 2).alias("g")).orderBy("i").collect()
    assert [r["e"] for r in got] == [None if v is None else f"{v:.2E}" for v in values] and got[0]["e"] == "1.12E+03"
    assert [r["f"] for r in got] == [None if v is None else f"{v:.3f}" for v in values]
    assert [r["g"] for r in got][2] == "0.12"
