"""Annealing with its state in tables against dense NumPy runs; blocks of any ids; restart and many matrices at once."""

import itertools

import dense
import numpy as np
import pytest

from frostline.operators import anneal, anneal_tables as at, blocks, distance
from frostline.sources import textfiles

UNIT = 1 / 32767
FAST = dict(minimum_count=5, initial_cooling=0.7, fine_cooling=0.85, converging_cooling=0.7, wait_iterations=2, freezing_limit=0.01)


def cloud(seed, n, k):
    rng = np.random.default_rng(seed)
    x = np.eye(8)[np.arange(n) % k] + 0.25 * rng.standard_normal((n, 8))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(x):
    return np.rint(32767 * (1 - x @ x.T) / 2).astype(np.int16)


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "idx int, vector array<double>")


def clusters(df):
    return np.array([r["cluster"] for r in df.orderBy("idx").collect()])


@pytest.mark.parametrize("options", [{}, {"split_method": 1}, {"split_method": 4}, {"continuous": True, "max_clusters": 2}, {"converge_intermediate": True, "split_method": 2}], ids=str)
def test_labels_equal_the_dense_run(spark, monkeypatch, options):
    k = options.get("max_clusters", 3)
    o, x = anneal.Options(**FAST | {"max_clusters": k} | options), cloud(1, 60, k)
    want, _, _ = dense.run(matrix(x).astype(float) * UNIT, o, 0.2, monkeypatch)
    labels, run = at.anneal(blocks.distance_blocks(vectors(spark, x, range(-90, 90, 3)), side=25), o, 0.2, strict=True)
    assert (clusters(labels) == want).all() and len(set(want)) == k
    t = run.matrix.timers.seconds
    assert all(t[c] > 0 for c in ("splitting", "exchange", "exchange_eigen", "reduce", "global_reductions", "thread_reductions"))
    run.matrix.close()


def test_a_run_that_stopped_goes_on(spark, tmp_path, monkeypatch):
    o, x = anneal.Options(**FAST, max_clusters=2), cloud(2, 40, 2)
    made = blocks.distance_blocks(vectors(spark, x))
    want, _, _ = dense.run(matrix(x).astype(float) * UNIT, o, 0.2, monkeypatch)
    first = at.BlockMatrices(made, f"file://{tmp_path}")
    run = at.TableAnnealer(first, o, 0.2, folder=f"file://{tmp_path}")
    steps, answer = run.run(), None
    for _ in range(45):
        answer = first.do([steps.send(answer)])[0]
    steps.close()
    labels, again = at.anneal(made, o, 0.2, folder=f"file://{tmp_path}", strict=True)
    assert again.log[:1] == run.log[:1] and 0 < again.matrix.timers.calls["exchange"] < again.progress.passes
    assert (clusters(labels) == want).all()
    # one table of each state that is still named, and no older ones
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) < 12


def test_parts_share_their_jobs(spark, monkeypatch):
    o = anneal.Options(**FAST, max_clusters=2)
    own = [cloud(s, n, 2) for s, n in ((3, 30), (4, 44), (5, 26))]
    rows = [(p, 100 * p + i, v.tolist()) for p, x in enumerate(own) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "part int, idx int, vector array<double>")
    labels, runs = at.anneal_parts(blocks.part_blocks(frame, side=16), {p: o for p in range(3)})
    got = {r["idx"]: r["cluster"] for r in labels.collect()}
    for p, x in enumerate(own):
        want, _, _ = dense.run(matrix(x).astype(float) * UNIT, o, None, monkeypatch)
        assert [got[100 * p + i] for i in range(len(x))] == want.tolist()
    longest = max(r.progress.passes for r in runs.values())
    assert runs[0].matrix.jobs < 3.2 * longest + 130


def test_a_strict_run_fails_before_its_end(spark):
    o, x = anneal.Options(**FAST, max_clusters=2), cloud(2, 20, 2)
    made = at.BlockMatrices(blocks.distance_blocks(vectors(spark, x)))
    with pytest.raises(at.NotConverged):
        at.drive(made, {0: at.TableAnnealer(made, o, 0.2, strict=True).run(max_passes=3)})
    assert np.allclose(made.times(np.arange(20.0)), matrix(x) @ np.arange(20.0) * UNIT)


def test_operators_equal_the_dense_ones():
    rng = np.random.default_rng(6)
    n, k = 25, 3
    d = rng.random((n, n))
    d = d + d.T
    s = anneal.em_pass(dense.Dense(d), anneal.State(rng.random((n, k)) / 10, 0.3, first=False), anneal.Options())
    state = at.State(at.Handle("", 0), 0.3, k, s.c, s.a, first=False)
    x = {"m": s.m, "y": s.b * s.c}
    v = rng.standard_normal((n, k))

    def applied(op, v):
        right = op.prepare(x, v)
        return op.apply(x, v, d @ right, right.sum(axis=0), (right * op.weights(x)).sum(axis=0))

    for factor in (0.5, 1.0):
        op = at.OwnVector(lambda x: (x["m"], x["y"] / s.c), s.c, s.a, 0.3, factor)
        assert np.allclose(applied(op, v[:, :, None])[:, :, 0], anneal.derivative_times(dense.Dense(d), s, v, factor))
    assert np.allclose(applied(at.OwnBlock(state, [0, 2]), v[:, [0, 2], None])[:, :, 0], anneal.block_derivative_times(dense.Dense(d), s, v)[:, [0, 2]])
    assert np.allclose(applied(at.Full(state), v[:, None, :])[:, 0], anneal.cross_derivative_times(dense.Dense(d), s, v))


def test_run_tells_of_eigen_test_and_moved_occupations(spark):
    o = anneal.Options(**FAST, max_clusters=2, eigen_test=True)
    labels, run = at.anneal(blocks.distance_blocks(vectors(spark, cloud(1, 40, 2)), side=25), o, 0.2, strict=True)
    left = [float(x.rsplit("residual=", 1)[1]) for x in run.log if "eigen test" in x]
    assert left and max(left) < 0.02 and len(set(clusters(labels))) == 2
    moved = [dict(p.split("=") for p in x.split(": ")[1].split()) for x in run.log if "occupations moved" in x]
    assert len(moved) == run.progress.splits == 1 and 0.3 < float(moved[0]["mean"]) < 0.7  # 40 points become about 20
    run.matrix.close()


def test_spectrum_that_does_not_settle_fails(spark):
    made = at.BlockMatrices(blocks.distance_blocks(vectors(spark, cloud(2, 20, 2))))
    with pytest.raises(at.NotConverged):
        at.critical_spectrum(made, tolerance=-1.0)


def test_ritz_values_of_a_full_space():
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((5, 1)), np.abs(rng.standard_normal((4, 1)))
    least, largest, c, residual = at._ritz(a, b, np.zeros(1))
    whole = np.diag(a[:, 0]) + np.diag(b[:, 0], 1) + np.diag(b[:, 0], -1)
    value, vector = np.linalg.eigh(whole)
    assert np.isclose(least[0], value[0]) and np.isclose(largest[0], value[-1]) and residual[0] == 0 and np.isclose(abs(c[:, 0] @ vector[:, 0]), 1)


def test_blocks_of_any_ids(spark):
    x = cloud(8, 23, 3)
    ids = np.array([*range(-40, 0, 5), *range(7, 22)])
    d = matrix(x)
    frame = vectors(spark, x, ids).unionByName(spark.createDataFrame([(None, [1.0]), (99, None)], "idx int, vector array<double>"))
    want = {(int(a), int(b)): int(d[i, j]) for (i, a), (j, b) in itertools.product(enumerate(ids), enumerate(ids))}
    assert {(r["i"], r["j"]): r["d"] for r in distance.from_vectors(frame, side=6).collect()} == want
    made = blocks.distance_blocks(frame, side=6)
    assert {(r["i"], r["j"]): r["d"] for r in blocks.to_cells(made).collect()} == want
    rows = blocks.to_rows(made)
    assert [r["d"] for r in rows.orderBy("i").collect()] == d.tolist()
    assert sorted(map(tuple, blocks.from_rows(rows, side=6).collect())) == sorted(map(tuple, made.collect()))
    assert distance.from_vectors(frame.where("false")).count() == 0


def test_merge_needs_every_pair(spark):
    made = blocks.distance_blocks(vectors(spark, cloud(9, 20, 2)), side=6)
    whole = sorted(map(tuple, made.collect()))
    assert sorted(map(tuple, blocks.merge(made.where("gi >= gj")).collect())) == whole == sorted(map(tuple, blocks.merge(made).collect()))
    assert blocks.merge(made.where("gi <= gj"), [1]).count() == 9
    with pytest.raises(ValueError, match="1 of 10 block pairs"):
        blocks.merge(made.where("not (gi = 1 and gj = 2 or gi = 2 and gj = 1)"))


def test_block_names_are_file_names(spark, tmp_path):
    folder = tmp_path / "run_3_4"
    folder.mkdir()
    (folder / "0_1.bin").write_bytes(np.arange(4, dtype="<i2").tobytes())
    (folder / "notes.bin").write_bytes(b"")
    got = textfiles.read_blocks(spark, str(folder / "*.bin"), 2).collect()
    assert {(r["bi"], r["bj"]) for r in got} == {(0, 1)} and [r["d"] for r in got] == [0, 1, 2, 3]


@pytest.mark.parametrize("parts", [1, 2])
def test_matrices_made_from_vectors_in_each_product(spark, monkeypatch, parts):
    monkeypatch.setattr(blocks, "SIDE", 16)
    monkeypatch.setattr(at, "TILE_POINTS", 24)
    x = cloud(7, 70, 2)
    rows = [(p, 100 * p + 3 * i, v.tolist()) for p in range(parts) for i, v in enumerate(x[: 70 - 9 * p])]
    made = at.BlockMatrices.of_vectors(spark.createDataFrame(rows, "part int, idx int, vector array<double>"), dense_bytes=0)
    assert made.kind == "<f8" and made.sizes == {p: 70 - 9 * p for p in range(parts)}
    assert "d" not in made.grid.columns
    w = np.arange(140.0).reshape(70, 2)
    assert np.allclose(made.times(w), matrix(x) @ w * UNIT)
    made.close()


def test_tiles_made_from_vectors_do_not_follow_their_number(spark, monkeypatch):
    """Twice the vectors meet as many tiles, each pair of packs is one tile, and only right-hand sides are sent to it."""
    monkeypatch.setattr(blocks, "SIDE", 16)
    monkeypatch.setattr(at, "TILE_POINTS", 16)
    tiles = []
    for n in (96, 192):
        x = cloud(8, n, 2)
        made = at.BlockMatrices.of_vectors(vectors(spark, x), dense_bytes=0)
        tiles.append(made.grid.count())
        packs = -(-n // (made.side * made.per_tile))
        assert tiles[-1] == packs * (packs + 1) // 2
        w = np.random.default_rng(n).random((n, 3))
        assert np.allclose(made.times(w), matrix(x) @ w * UNIT)
        made.close()
    assert tiles[0] == tiles[1]
