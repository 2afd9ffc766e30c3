"""Queries of the annealing state in tables: one pass, Lanczos vectors of each split method, the continuous fixed point, and many matrices at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import anneal_tables as at, anneal_vectors, em
from ..operators.anneal import Options
from . import inputs
from .inputs import D
from .registry import query

T, K = 0.02, 3

#: Energies (idx * (k + 1)) % 7 / 100 of three clusters, and one pass from them.
PASS = D + """, n AS (SELECT count(*) AS n FROM e), kk AS (SELECT unnest(range(3)) AS k),
e0 AS (SELECT i AS idx, CAST(k AS INTEGER) AS k, 0.01e0 * ((i * (k + 1)) % 7) AS eps FROM e CROSS JOIN kk),
w AS (SELECT idx, k, exp(-(eps - min(eps) OVER (PARTITION BY idx)) / 0.02e0) AS x FROM e0),
m AS (SELECT idx, k, x / sum(x) OVER (PARTITION BY idx) AS m FROM w),
c AS (SELECT k, sum(m) AS c FROM m GROUP BY k),
b AS (SELECT d.i AS idx, m.k, sum(d.d / 32767e0 * m.m) / any_value(c.c) AS b FROM d JOIN m ON m.idx = d.j JOIN c ON c.k = m.k GROUP BY d.i, m.k),
a AS (SELECT b.k, any_value(c.c) AS c, -0.5e0 * sum(b.b * m.m) / any_value(c.c) AS a FROM b JOIN m USING (idx, k) JOIN c ON c.k = b.k GROUP BY b.k),
s AS (SELECT m.idx, m.k, m.m, b.b, a.a, a.c FROM m JOIN b USING (idx, k) JOIN a ON a.k = m.k)"""


def _state(matrix: at.BlockMatrices, doubled: list[int] | None = None) -> at.Run:
    """The state after one pass from the given energies."""
    start = yield at.Rewrite(matrix.start[0], lambda x: {"y": 0.01 * ((x["ids"][:, None] * np.arange(1, K + 1)) % 7)})
    s = at.State(start, T, K, np.ones(K), np.zeros(K), first=False)
    return (yield from at.TableAnnealer(matrix).em(s, doubled))


def _matrix(spark: SparkSession, sf: str) -> at.BlockMatrices:
    return at.BlockMatrices.of_vectors(inputs.vectors(spark, sf))


@query("q27_block_em_pass", PASS + " SELECT idx, k, round(m, 6) AS m, round(b, 6) AS b, round(b + a, 6) AS eps FROM s")
def _(spark, sf):
    matrix = _matrix(spark, sf)
    s = at.drive(matrix, {0: _state(matrix)})[0]
    out = matrix.long(s.at, {"m": lambda x: x["m"], "b": lambda x: x["y"] / s.c, "eps": lambda x: x["y"] / s.c + s.a})
    return out.select("idx", "k", *(F.round(c, 6).alias(c) for c in ("m", "b", "eps")))


def _own(s: str, m: str) -> tuple[str, str]:
    """(right-hand side, operator) of a cluster on its own vector as SQL, for a table ``s`` with columns m, b, a, c and factor f."""
    return (
        f"SELECT s.idx, s.k, s.{m} * v.v AS r FROM {s} s JOIN v{{j}} v USING (idx, k)",
        f"SELECT s.idx, s.k, s.{m} * s.f * v.v + s.{m} * s.f / (0.02e0 * s.c) * (-(2 * s.a + s.b) * t.s1 - t.s2 + u.u) AS w FROM {s} s JOIN v{{j}} v USING (idx, k) JOIN u{{j}} u USING (idx, k) JOIN t{{j}} t ON t.k = s.k",
    )


def _lanczos_sql(s: str, right: str, operator: str, by: str, start: str = "1", weights: str = "") -> str:
    """Two steps: v1 is what O v0 adds to v0, v2 what O v1 adds to both; ``by`` names the columns of one vector, ``weights`` has b of each right-hand side."""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    names = f"{by}, " if by else ""
    out = f""", v0 AS (SELECT s.idx, s.k, y / sqrt(sum(y * y) OVER ({part})) AS v FROM (SELECT idx, k, (1 + 0.5e0 * idx / n) * {start} AS y FROM {s} CROSS JOIN n) s)"""
    for j in (0, 1):
        out += f""", r{j} AS ({right.format(j=j)}), u{j} AS (SELECT d.i AS idx, r.k, sum(d.d / 32767e0 * r.r) AS u FROM d JOIN r{j} r ON r.idx = d.j GROUP BY d.i, r.k),
t{j} AS (SELECT r.k, sum(r.r) AS s1, sum(r.r * s.b) AS s2 FROM r{j} r JOIN {weights or s} s USING (idx, k) GROUP BY r.k), w{j} AS ({operator.format(j=j)})"""
        held = "".join(f", h{j}{i} AS (SELECT {names}sum(w.w * v.v) AS h FROM (SELECT idx, k, w FROM w{j}) w JOIN v{i} v USING (idx, k) {group.replace(by, 'w.' + by) if by else ''})" for i in range(j + 1))
        held = held.replace("SELECT k, sum", "SELECT w.k, sum")
        left = " - ".join(["w.w", *(f"h{i}.h * v{i}.v" for i in range(j + 1))])
        joins = " ".join(f"JOIN v{i} v{i} USING (idx, k) JOIN h{j}{i} h{i} {'ON h' + str(i) + '.k = w.k' if by else 'ON true'}" for i in range(j + 1))
        out += held + f", x{j} AS (SELECT w.idx, w.k, {left} AS x FROM w{j} w {joins}), v{j + 1} AS (SELECT idx, k, x / sqrt(sum(x * x) OVER ({part})) AS v FROM x{j})"
    return out + " SELECT idx, k, round(v, 6) AS v FROM v2"


def _vectors(matrix: at.BlockMatrices, s: at.State, op: at.Operator) -> DataFrame:
    """(idx, k, v) of the third Lanczos vector."""
    e = at.drive(matrix, {0: at.lanczos(matrix.n, s.at, op, Options(), steps=3)})[0]
    out = matrix.long(e.at, {"v": lambda x: x["v"].reshape(len(x["at"]), 3, -1)[:, 2]})
    return out.select("idx", "k", F.round("v", 6).alias("v"))


PLAIN = ", sp AS (SELECT *, 0.5e0 AS f FROM s)"


@query("q28_lanczos_half_shares", PASS + PLAIN + _lanczos_sql("sp", *_own("sp", "m"), "k"))
def _(spark, sf):
    """Split method 2: each cluster's plain operator."""
    matrix = _matrix(spark, sf)
    s = at.drive(matrix, {0: _state(matrix)})[0]
    return _vectors(matrix, s, at.OwnVector(lambda x: (x["m"], x["y"] / s.c), s.c, s.a, T, 0.5))


#: Least Ritz value of two steps (a 2 x 2 matrix), and how far its vector is from an eigenvector.
RESIDUAL = """, tri AS (SELECT h00.k, h00.h AS a0, h11.h AS a1, h10.h AS b FROM h00 JOIN h11 USING (k) JOIN h10 USING (k)),
low AS (SELECT *, (a0 + a1) / 2 - sqrt(((a0 - a1) / 2) ** 2 + b * b) AS least FROM tri),
co AS (SELECT k, least, b / sqrt(b * b + (least - a0) ** 2) AS y0, (least - a0) / sqrt(b * b + (least - a0) ** 2) AS y1 FROM low)
SELECT w0.k, round(any_value(least), 6) AS least, round(sqrt(sum((y0 * w0.w + y1 * w1.w - least * (y0 * v0.v + y1 * v1.v)) ** 2)), 6) AS residual
FROM w0 JOIN w1 USING (idx, k) JOIN v0 USING (idx, k) JOIN v1 USING (idx, k) JOIN co ON co.k = w0.k GROUP BY w0.k"""


@query("q64_eigen_test", PASS + PLAIN + _lanczos_sql("sp", *_own("sp", "m"), "k").split(" SELECT idx, k, round(v, 6)")[0] + RESIDUAL)
def _(spark, sf):
    """Self-test of a spectrum after two steps: the least value of each cluster's plain operator, and what one more application leaves of its vector."""
    matrix = _matrix(spark, sf)

    def tested() -> at.Run:
        s = yield from _state(matrix)
        op = at.OwnVector(lambda x: (x["m"], x["y"] / s.c), s.c, s.a, T, 0.5)
        e = yield from at.lanczos(matrix.n, s.at, op, Options(), steps=2)
        return (yield from at.eigen_test(e, op))

    e, residual = at.drive(matrix, {0: tested()})[0]
    out = [(k, float(e.least[k]), float(residual[k])) for k in range(K)]
    return spark.createDataFrame(out, "k int, least double, residual double").select("k", F.round("least", 6).alias("least"), F.round("residual", 6).alias("residual"))


#: Each cluster counted twice in its own replica of the pass.
DOUBLED = PASS.replace("m AS (SELECT idx, k, x / sum(x) OVER (PARTITION BY idx) AS m FROM w)", "m0 AS (SELECT q.k AS q, w.idx, w.k, w.x / sum(CASE WHEN w.k = q.k THEN 2 ELSE 1 END * w.x) OVER (PARTITION BY q.k, w.idx) AS m FROM w CROSS JOIN kk q), m AS (SELECT idx, k, m FROM m0 WHERE q = k)")


@query("q29_lanczos_doubled", DOUBLED + ", sp AS (SELECT *, 1e0 AS f FROM s)" + _lanczos_sql("sp", *_own("sp", "m"), "k"))
def _(spark, sf):
    """Split method 3: each cluster's operator where it counts twice."""
    matrix = _matrix(spark, sf)
    s = at.drive(matrix, {0: _state(matrix, list(range(K)))})[0]
    own = np.arange(K) * (K + 1)
    return _vectors(matrix, s, at.OwnVector(lambda x: (x["m"][:, own], (x["y"] / s.c)[:, own]), s.c[own], s.a[own], T, 1.0))


#: Right-hand sides of each cluster's own block: k = 3 * cluster + c, with b of c.
BLOCK = ", s9 AS (SELECT s.idx, 3 * o.k + s.k AS k, o.k AS own, s.k AS c, o.m AS mo, s.m - CASE WHEN o.k = s.k THEN 1 ELSE 0 END AS l, s.b, s.a, s.c AS size FROM s JOIN s o ON o.idx = s.idx)"
BLOCK_RIGHT = "SELECT s.idx, s.k, s.mo * v.v * s.l AS r FROM s9 s JOIN v{j} v ON v.idx = s.idx AND v.k = s.own"
BLOCK_OPERATOR = """SELECT s.idx, s.own AS k, any_value(s.mo) / 0.02e0 * sum(s.l * (-(2 * s.a + s.b) * t.s1 - t.s2 + u.u) / s.size) + any_value((s.mo - s.mo * s.mo) * v.v) AS w
FROM s9 s JOIN v{j} v ON v.idx = s.idx AND v.k = s.own JOIN u{j} u ON u.idx = s.idx AND u.k = s.k JOIN t{j} t ON t.k = s.k GROUP BY s.idx, s.own"""


@query("q33_lanczos_own_block", PASS + BLOCK + _lanczos_sql("s", BLOCK_RIGHT, BLOCK_OPERATOR, "k", weights="s9"))
def _(spark, sf):
    """Split method 1: each cluster's own block of the full operator."""
    matrix = _matrix(spark, sf)
    s = at.drive(matrix, {0: _state(matrix)})[0]
    return _vectors(matrix, s, at.OwnBlock(s, list(range(K))))


FULL_RIGHT = "SELECT idx, k, sum(mv) OVER (PARTITION BY idx) * m - mv AS r FROM (SELECT s.idx, s.k, s.m, s.m * v.v AS mv FROM s JOIN v{j} v USING (idx, k))"
FULL_OPERATOR = """SELECT idx, k, m / 0.02e0 * (sum(m * q) OVER (PARTITION BY idx) - q) + m * (v - sum(m * v) OVER (PARTITION BY idx)) AS w
FROM (SELECT s.idx, s.k, s.m, v.v, (-(2 * s.a + s.b) * t.s1 - t.s2 + u.u) / s.c AS q FROM s JOIN v{j} v USING (idx, k) JOIN u{j} u USING (idx, k) JOIN t{j} t ON t.k = s.k)"""


@query("q30_lanczos_full", PASS + _lanczos_sql("s", FULL_RIGHT, FULL_OPERATOR, "", "(CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END)"))
def _(spark, sf):
    """Split method 4: the operator over all clusters at once."""
    matrix = _matrix(spark, sf)
    s = at.drive(matrix, {0: _state(matrix)})[0]
    return _vectors(matrix, s, at.Full(s))


ROUNDS = 5
FIXED = PASS.split(", n AS (SELECT count(*)")[0] + """, kk AS (SELECT unnest(range(3)) AS k), e0 AS (SELECT i AS idx, CAST(k AS INTEGER) AS k, 0.01e0 * ((i * (k + 1)) % 7) AS eps FROM e CROSS JOIN kk),
f AS (SELECT idx, list(exp(-eps / 0.02e0) ORDER BY k) AS x FROM e0 GROUP BY idx),
r(it, p) AS (
    SELECT 0, [1e0 / 3, 1e0 / 3, 1e0 / 3]
    UNION ALL
    SELECT it + 1, (SELECT [avg(x[1] * r.p[1] / (x[1] * r.p[1] + x[2] * r.p[2] + x[3] * r.p[3])), avg(x[2] * r.p[2] / (x[1] * r.p[1] + x[2] * r.p[2] + x[3] * r.p[3])), avg(x[3] * r.p[3] / (x[1] * r.p[1] + x[2] * r.p[2] + x[3] * r.p[3]))] FROM f)
    FROM r WHERE it < 5)
SELECT CAST(it AS INTEGER) AS it, CAST(k AS INTEGER) AS k, round(p[k + 1], 6) AS p FROM r CROSS JOIN kk WHERE it > 0"""
FIXED = FIXED.replace("WITH e AS", "WITH RECURSIVE e AS", 1)


@query("q31_continuous_rounds", FIXED)
def _(spark, sf):
    """Continuous mode: shares of the points and weights of the clusters follow each other; the weights of each round."""
    ids = inputs.assignment(spark, sf).select("idx")
    eps = ids.select("idx", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("k")).select("idx", "k", (F.lit(0.01) * ((F.col("idx") * (F.col("k") + 1)) % 7)).alias("eps"))
    out = None
    for it, p, _ in em.fixed_point(eps, T, K, ROUNDS, tolerance=0.0):
        one = p.select(F.lit(it).alias("it"), "k", F.round("p", 6).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out


@query("q32_part_labels")
def _(spark, sf):
    """(part, idx, cluster): the points of each label annealed on their own, all labels together; each part splits in two at most."""
    e = inputs.vectors(spark, sf).join(inputs.assignment(spark, sf), "idx").select(F.col("cluster").alias("part"), "idx", "vector")
    fast = Options(max_clusters=2, initial_cooling=0.7, fine_cooling=0.85, converging_cooling=0.7, wait_iterations=2, minimum_count=5, freezing_limit=0.01)
    return anneal_vectors.anneal_parts(e, fast)[0]
