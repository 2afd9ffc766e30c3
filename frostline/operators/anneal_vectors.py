"""Annealing of the distances of unit vectors without their matrix: a run of ``anneal_tables`` whose products are sums over the vectors.

The distance of two unit vectors is (1 - x y) / 2, so what a point's row of distances gives with any columns r is (sum of r - x (sum of r x)) / 2.  A product is one
aggregation of (width + 1) x K sums over the points, and everything a point has (energies, shares, Lanczos vectors) follows from its own vector and such sums.  So no
state is stored or shuffled: a handle names the steps that lead to it, each task makes a block's columns anew from its vectors, and a job's work grows with N and not N x N.
Steps that would make this chain long are cut by writing the state as a table (``LONGEST``).

Distances are not rounded to the 1 / 32767 of stored matrices, from which they differ by half a unit at most.  Where no split or label is so near a tie, labels are the same;
``anneal_tables.BlockMatrices`` keeps the rounded ones, for runs with many near ties.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks as made_blocks, store
from .anneal import Options
from .anneal_tables import ARRAYS, Arrays, BlockMatrices, Handle, Product, Request, Rewrite, Sums, TableAnnealer, drive

#: Points of a block at most, and where a matrix has fewer of them than tasks.
POINTS, LEAST = 4096, 512
#: Steps behind a handle at most; then its state is written as a table.
LONGEST = 32
#: Rows of sums that come to the driver at most for each part; those of more tasks are added up by Spark first.
DIRECT = 64
_STORED = "part int, p int, ids binary, x binary, " + ", ".join(f"{c} binary" for c in ARRAYS)


@dataclass
class Step:
    """A state: the columns of a ``table`` of blocks, or what a request makes of the step before it; ``product`` has the sums of a product's columns and of these times the vectors."""

    base: str
    prev: Step | None = None
    to: Callable[..., object] | None = None
    column: str | None = None
    product: np.ndarray | None = None
    keep: tuple[str, ...] = ()
    depth: int = 0
    table: bool = False

    def only_product(self) -> Step:
        """The same with no column but the product, which needs no earlier step."""
        return replace(self, prev=None, to=None, keep=(), depth=0, table=False) if self.product is not None else self

    def get(self, rows: Rows, c: str) -> np.ndarray | None:
        if self.product is not None and c == self.column:
            return (self.product[0] - rows["x"] @ self.product[1:]) / 2
        if self.prev is None or self.to is None:
            # columns of the table are those of the step that wrote it, and not of later ones
            return rows["stored"].get(c) if self.table else None
        before = rows.before()
        if c in self.keep and c in before:
            return before[c]
        if not rows.made:
            rows.made = True
            new = self.to(before) if self.product is None else self.to(before, rows[self.column])
            for k, v in new.items():
                rows.setdefault(k, v)
        return dict.get(rows, c)


class Rows(dict):
    """Columns of a block's rows, made when they are asked for."""

    def __init__(self, fixed: Arrays, step: Step):
        super().__init__(fixed)
        self.step, self.made, self.fixed, self._before = step, False, fixed, None

    def before(self) -> Rows:
        if self._before is None:
            self._before = Rows(self.fixed, self.step.prev)
        return self._before

    def __missing__(self, c: str) -> np.ndarray:
        if (found := self.step.get(self, c)) is None:
            raise KeyError(c)
        self[c] = found
        return found

    def __contains__(self, c: object) -> bool:
        try:
            return self[c] is not None
        except KeyError:
            return False

    def __or__(self, other: Arrays) -> Rows:
        out = Rows(self.fixed, self.step)
        out.update(self)
        out.update(other)
        out.made, out._before = self.made, self._before
        return out


def _blocks(batches: Iterator[pa.RecordBatch], side: int, kind: str, parts: Container[int]) -> Iterator[tuple[int, pa.RecordBatch, Arrays]]:
    """(part, the block as a row, its columns as matrices) of some parts."""
    for b in batches:
        for row, part in enumerate(b.column("part").to_pylist()):
            if part not in parts:
                continue
            one = b.slice(row, 1)
            ids = np.frombuffer(one.column("ids")[0].as_buffer(), np.int64)
            g, n = one.column("p")[0].as_py(), len(ids)
            out = {"at": g * side + np.arange(n), "g": g, "ids": ids, "x": np.frombuffer(one.column("x")[0].as_buffer(), kind).astype(np.float64).reshape(n, -1), "held": {}, "stored": {}}
            for c in ARRAYS:
                if c in b.schema.names and (v := one.column(c)[0]).is_valid:
                    out["stored"][c] = np.frombuffer(v.as_buffer(), np.float64).reshape(n, -1)
            yield part, one, out


_SUMS = "part int, sums binary"


def _sums(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sums, added up by part in their order."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for p, x in zip(b.column("part").to_pylist(), b.column("sums")):
            x = np.frombuffer(x.as_buffer(), np.float64)
            held[p] = held[p] + x if p in held else x
    yield _sums(held)


class VectorMatrices(BlockMatrices):
    """The distances of unit vectors(idx, vector[, part]), each part a matrix of its own; answers the requests of runs by sums over the vectors."""

    def __init__(self, vectors: DataFrame, points: int | None = None):
        self._begin(vectors.sparkSession, None)
        tasks = self.parent.sparkContext.defaultParallelism
        part = F.col("part").cast("int") if "part" in vectors.columns else F.lit(0)
        if points is None:
            total = vectors.where("idx is not null and vector is not null").count()
            points = max(LEAST, min(POINTS, -(-total // max(1, tasks))))
        packs, packing = made_blocks.vector_packs(vectors.withColumn("part", part), points, 1)
        self.side, self.kind = packing.side, packing.kind
        found = packs.groupBy("part").agg(F.sum(F.length("ids") / 8).cast("long").alias("n"), F.count(F.lit(1)).alias("blocks"), F.sum(F.length("x")).alias("bytes")).collect()
        self.sizes = {r["part"]: r["n"] for r in sorted(found)}
        self.dims = sum(r["bytes"] for r in found) // max(1, np.dtype(self.kind).itemsize * sum(self.sizes.values()))
        count = sum(r["blocks"] for r in found)
        # so few points a task that all tasks have work, but not so few that its start costs more
        self.partitions = max(1, min(count, -(-sum(self.sizes.values()) // points), max(tasks, sum(r["bytes"] for r in found) // made_blocks.PACK_BYTES)))
        self.names, self.steps, self.bases = 0, {}, {}
        starts, before = [], 0
        for r in sorted(found):
            starts.append((r["part"], before))
            before += r["blocks"]
        # blocks are dealt in turn, so that tasks have as many
        packs = self.spark.read.schema(packs.schema).parquet(*packs.inputFiles()).join(F.broadcast(self.spark.createDataFrame(starts, "part int, _start long")), "part")
        dealt = packs.repartitionById(self.partitions, F.pmod(F.col("_start") + F.col("p"), F.lit(self.partitions)).cast("int")).sortWithinPartitions("part", "p")
        self.grid = dealt.select("part", "p", "ids", "x").persist()
        self.bases: dict[str, DataFrame] = {"": self.grid}
        self.steps: dict[str, Step] = {}
        self.start = {p: self._named(Step(""), p) for p in self.sizes}

    def _named(self, step: Step, part: int) -> Handle:
        path = f"step-{len(self.steps)}-{time.perf_counter_ns()}"
        self.steps[path] = step
        return Handle(path, part)

    def forget(self, live: set[str]) -> None:
        live = live | {h.path for h in self.start.values()}
        self.steps = {k: v for k, v in self.steps.items() if k in live}
        used = {s.base for s in self.steps.values()} | {""}
        super().forget(used)
        self.bases = {k: v for k, v in self.bases.items() if k in used}

    def close(self) -> None:
        self.forget(set())
        self.grid.unpersist()

    def _map(self, of: dict[int, tuple[Step, Callable[[Rows, pa.RecordBatch], pa.RecordBatch]]], schema: str) -> list[DataFrame]:
        """What functions make of the blocks of their parts, a table for each base."""
        out, side, kind = [], self.side, self.kind
        for base, own in self._by_base(of).items():

            def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
                for part, row, fixed in _blocks(batches, side, kind, own):
                    step, made = own[part]
                    yield made(Rows(fixed, step), row)

            out.append(self.bases[base].mapInArrow(run, schema))
        return out

    @staticmethod
    def _by_base(of: dict[int, tuple]) -> dict[str, dict[int, tuple]]:
        out: dict[str, dict[int, tuple]] = {}
        for part, x in of.items():
            out.setdefault(x[0].base, {})[part] = x
        return out

    def _totals(self, of: dict[int, tuple[Step, Callable[[Rows], np.ndarray]]]) -> dict[int, np.ndarray]:
        """Sums over all blocks of each part, added up in a task first."""
        out: dict[int, np.ndarray] = {}
        side, kind = self.side, self.kind
        for base, own in self._by_base(of).items():

            def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
                held: dict[int, np.ndarray] = {}
                for part, _, fixed in _blocks(batches, side, kind, own):
                    step, f = own[part]
                    began = time.perf_counter()
                    x = np.asarray(f(Rows(fixed, step)), np.float64).ravel()
                    x = np.append(x, time.perf_counter() - began)
                    held[part] = held[part] + x if part in held else x
                yield _sums(held)

            got = self.bases[base].mapInArrow(run, _SUMS)
            if self.partitions > DIRECT:
                got = got.withColumn("_at", F.spark_partition_id()).repartitionById(DIRECT, F.pmod("_at", F.lit(DIRECT))).sortWithinPartitions("_at").select("part", "sums").mapInArrow(_added, _SUMS)
            self.jobs += 1
            table = got.toArrow()
            for p, x in zip(table.column("part").to_pylist(), table.column("sums")):
                x = np.frombuffer(x.as_buffer(), np.float64)
                out[p] = out[p] + x if p in out else x
        self.timers.add("thread_reductions", sum(x[-1] for x in out.values()))
        return {p: x[:-1] for p, x in out.items()}

    def do(self, requests: list[Request]) -> list[object]:
        """Answers of requests of different parts: the sums of all are one job, and one more adds up what needs a product; new columns alone take none."""
        asked = {r.state.part: (self.steps[r.state.path], _right_sums(r) if isinstance(r, Product) else r.of) for r in requests if not isinstance(r, Rewrite)}
        products = [r for r in requests if isinstance(r, Product)]
        with self.timers.measure("global_reductions" if not products else "exchange_eigen" if all(r.eigen for r in products) else "exchange"):
            sums = self._totals(asked) if asked else {}
        new: dict[int, Step] = {}
        late: dict[int, tuple[Step, Callable[[Rows], np.ndarray]]] = {}
        for r in requests:
            part, prev = r.state.part, self.steps[r.state.path]
            if isinstance(r, Rewrite):
                new[part] = Step(prev.base, prev, r.to, depth=prev.depth + 1)
            elif isinstance(r, Product):
                size = r.width * (1 + self.dims)
                product, sums[part] = sums[part][:size].reshape(1 + self.dims, r.width), sums[part][size:]
                if r.dot:
                    # the sum of r (D r) over the points, from the same sums
                    sums[part] = np.append(sums[part], (product[0] ** 2 - (product[1:] ** 2).sum(axis=0)) / 2)
                if r.moves is not None:
                    product = np.where(r.moves, product, prev.product)
                before = prev.only_product() if r.uses == (prev.column,) else prev
                new[part] = Step(before.base, before, r.made or (lambda x, u, r=r: r.after(x, u)[0]), r.column, product, r.keep, before.depth + 1)
                if r.early is None:
                    late[part] = new[part], lambda x, r=r: r.after(x.before(), x[r.column])[1]
        if late:
            sums |= self._totals(late)
        out: list[object] = []
        for r in requests:
            part = r.state.part
            if isinstance(r, Sums):
                out.append(sums[part])
                continue
            at = self._named(self._stored(new[part], part) if new[part].depth > LONGEST else new[part], part)
            out.append((at, sums[part]) if isinstance(r, Product) else at)
        return out

    def _stored(self, step: Step, part: int) -> Step:
        """The state as a table of blocks with all its columns."""

        def made(rows: Rows, row: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([np.ascontiguousarray(rows[c], np.float64).tobytes() if c in rows else None], pa.binary()) for c in ARRAYS]
            return pa.RecordBatch.from_arrays([*(row.column(c) for c in ("part", "p", "ids", "x")), *columns], schema=pa.schema([(c, row.schema.field(c).type) for c in ("part", "p", "ids", "x")] + [(c, pa.binary()) for c in ARRAYS]))

        self.jobs += 1
        path = self._write(self._map({part: (step, made)}, _STORED)[0])
        self.bases[path] = self.spark.read.schema(_STORED).parquet(path)
        return Step(path, column=step.column, product=step.product, table=True)

    def rows(self, states: list[Handle]) -> DataFrame:
        raise TypeError("states of vectors are made anew and not kept as rows")

    def times(self, x: np.ndarray) -> np.ndarray:
        """D x of the first part for a driver's array: for checks of small matrices."""
        part, flat = next(iter(self.sizes)), x.reshape(self.n, -1)
        at, _ = self.do([Product(self.start[part], lambda b: flat[b["at"]], lambda b, u: ({"y": u}, np.zeros(1)), 1, (), width=flat.shape[1])])[0]
        got = self._map({part: (self.steps[at.path], lambda rows, row: pa.RecordBatch.from_arrays([pa.array(rows["at"]), pa.array(rows["y"].tolist())], names=["at", "y"]))}, "at long, y array<double>")[0]
        return np.array([r["y"] for r in got.orderBy("at").collect()]).reshape(x.shape)

    def labels(self, states: list[tuple[Handle, np.ndarray, np.ndarray]]) -> DataFrame:
        """(part, idx, cluster) as a table: the first cluster of least energy, for (handle, divisor, shift)."""

        def of(part: int, c: np.ndarray, a: np.ndarray) -> Callable[[Rows, pa.RecordBatch], pa.RecordBatch]:
            def made(rows: Rows, row: pa.RecordBatch) -> pa.RecordBatch:
                label = (rows["y"] / c + a).argmin(axis=1)
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(label), part, np.int32)), pa.array(rows["ids"].astype(np.int32)), pa.array(label.astype(np.int32))], names=["part", "idx", "cluster"])

            return made

        schema = "part int, idx int, cluster int"
        rows = self._map({h.part: (self.steps[h.path], of(h.part, c, a)) for h, c, a in states}, schema)
        path = store.new_path(self.parent, "labels")
        made = rows[0]
        for more in rows[1:]:
            made = made.unionByName(more)
        made.write.parquet(path)
        return self.parent.read.schema(schema).parquet(path)


def _right_sums(r: Product) -> Callable[[Rows], np.ndarray]:
    """Sums of a product's right-hand side and of it times the vectors, and those that need no product."""

    def of(x: Rows) -> np.ndarray:
        right = r.left(x)
        sums = [right.sum(axis=0), (x["x"].T @ right).ravel()]
        return np.concatenate(sums if r.early is None else [*sums, r.early(x, right)])

    return of


def anneal_parts(vectors: DataFrame, options: Options) -> tuple[DataFrame, dict[int, TableAnnealer]]:
    """((part, idx, cluster), the runs by part) of the distances inside each part of unit vectors(idx, vector, part), all together."""
    matrix = VectorMatrices(vectors)
    runs = {p: TableAnnealer(matrix, options, part=p) for p in matrix.sizes}
    done = drive(matrix, {p: r.run() for p, r in runs.items()}, lambda: set().union(*(r.live() for r in runs.values())))
    labels = matrix.labels([(s.at, s.c, s.a) for s in done.values()])
    matrix.close()
    return labels, runs
