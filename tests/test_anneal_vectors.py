"""Annealing of vectors without their matrix against dense NumPy runs over the rounded distances."""

import os

import dense
import numpy as np
import pytest

import frostline.catalog as catalog
from frostline.operators import anneal, anneal_tables as at, anneal_vectors as av, blocks
from frostline.operators.timers import Timers
from test_tables import FAST, UNIT, cloud, matrix

SF = "/root/testdata/sf0.001"


def parts_of(spark, own):
    rows = [(p, 100 * p + i, v.tolist()) for p, x in enumerate(own) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "part int, idx int, vector array<double>")


class Held:
    """A stored matrix in memory that answers the same requests."""

    def __init__(self, d):
        self.d, self.sizes, self.timers, self.states = d, {0: len(d)}, Timers(), {"": {}}
        self.start = {0: at.Handle("", 0)}

    def forget(self, live):
        pass

    def put(self, columns):
        self.states[str(len(self.states))] = dict(columns)
        return at.Handle(str(len(self.states) - 1), 0)

    def do(self, requests):
        (r,) = requests
        x = {"at": np.arange(len(self.d)), "g": 0} | self.states[r.state.path]
        if isinstance(r, at.Sums):
            return [np.ravel(r.of(x))]
        if isinstance(r, at.Rewrite):
            return [self.put(r.to(x))]
        new, sums = r.after(x, self.d @ r.left(x))
        return [(self.put({c: x[c] for c in r.keep if c in x} | new), np.asarray(sums))]


@pytest.mark.parametrize("options, longest", [({"max_clusters": 3}, 2), ({"max_clusters": 2, "split_method": 4}, 32)], ids=str)
def test_labels_equal_the_dense_runs(spark, monkeypatch, options, longest):
    """Three clusters have replicas that stop early; with short chains, states are cut to tables in between."""
    monkeypatch.setattr(av, "LONGEST", longest)
    o = anneal.Options(**FAST | options)
    own = [cloud(s, n, 3) for s, n in ((1, 60), (4, 44))]
    labels, runs = av.anneal_parts(parts_of(spark, own), o)
    got = {(r["part"], r["idx"]): r["cluster"] for r in labels.collect()}
    for p, x in enumerate(own):
        want, _, _ = dense.run(matrix(x).astype(float) * UNIT, o, None, monkeypatch)
        assert [got[p, 100 * p + i] for i in range(len(x))] == want.tolist()


def test_products_of_several_blocks(spark):
    x = cloud(7, 70, 2)
    made = av.VectorMatrices(parts_of(spark, [x]), points=16)
    assert made.partitions > 1 and made.sizes == {0: 70}
    w = np.arange(140.0).reshape(70, 2)
    assert np.allclose(made.times(w), (1 - x @ x.T) / 2 @ w)
    made.close()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_part_labels_make_no_matrix(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a matrix is made")

    for name in ("part_blocks", "distances"):
        monkeypatch.setattr(blocks, name, refused)
    monkeypatch.setattr(at.BlockMatrices, "__init__", refused)
    rows = catalog.QUERIES["q32_part_labels"](spark, SF).collect()
    e = {r["vec_id"]: r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert sorted(r["idx"] for r in rows) == sorted(e) and all(r["part"] == e[r["idx"]]["label"] for r in rows)
    o = anneal.Options(**FAST | {"max_clusters": 2})
    for part in range(10):
        own = sorted((r["idx"], r["cluster"]) for r in rows if r["part"] == part)
        held = Held(matrix(np.array([e[i]["embedding"] for i, _ in own], float)) * UNIT)
        run = at.TableAnnealer(held, o)
        s = at.drive(held, {0: run.run()})[0]
        assert [c for _, c in own] == (held.states[s.at.path]["y"] / s.c + s.a).argmin(axis=1).tolist()
