"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded: the mean of its words' rows in a fixed random
projection of hashed words, and shares of word shapes; a learned layer follows.  Gated attention weights the encoded passages,

    a = softmax( w . (tanh(V h) * sigmoid(U h)) ),    z = sum a h,    score = sigmoid(c . z + b)

and all parameters are learned together from document labels by Adam on the logistic loss.  Training takes about
``sample_rows`` labelled rows and ``sample_passages`` passages, picked by a hash of the id: features are made in tasks, the small matrix is fitted on the driver, and
the parameters (a few thousand numbers) go back to all tasks, which encode and score whole texts.

Defined results: null and empty texts are one all-zero passage and get a score as others; labels that are null are ignored, and of repeated
labels of one id the largest counts; rows that repeat an id are examples each; without labels of both kinds the score is their share, or 0.5 with none;
a text of any length is scored by all its passages; an empty table gives no rows; other columns of the input keep their values in ``score``, but for one that has the name of its output, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .common import crc_mod, tune

PASSAGE, HASHED, BUCKETS, HIDDEN, GATE = 64, 20, 1 << 14, 24, 12
_PROJECTION = np.random.default_rng(5).standard_normal((BUCKETS, HASHED)).astype(np.float32)
_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_MARK = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
SHAPES = 14
FEATURES = HASHED + SHAPES


def _count(flag: np.ndarray, w: tk.Words) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return s[w.end] - s[w.start]


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first passage of each document and behind the last, passages x FEATURES)."""
    w = tk.words(texts)
    n = np.diff(w.first)
    passages = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(passages)])
    x = np.zeros((first[-1], FEATURES), np.float32)
    if not len(w.h):
        return first, x
    place = np.arange(len(w.h)) - np.repeat(w.first[:-1], n)
    starts = np.flatnonzero(place % PASSAGE == 0)
    filled = np.concatenate([np.arange(first[d], first[d] + passages[d]) for d in np.flatnonzero(n)]) if (n == 0).any() else np.arange(first[-1])
    size = np.diff(np.append(starts, len(w.h)))[:, None].astype(np.float32)
    x[filled, :HASHED] = np.add.reduceat(_PROJECTION[(w.h & tk.U(BUCKETS - 1)).astype(np.int64)], starts, axis=0) / np.sqrt(size)
    length = w.end - w.start
    upper, digit, punct, mark = (_count(t[w.data], w) for t in (_UPPER, _DIGIT, _PUNCT, _MARK))
    last = w.data[w.end - 1]
    order = np.lexsort((w.h, np.searchsorted(starts, np.arange(len(w.h)), "right")))
    group = np.searchsorted(starts, order, "right")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.h[order[1:]] != w.h[order[:-1]]) | (group[1:] != group[:-1])
    new = np.zeros(len(order))
    new[order] = fresh
    shape = np.stack(
        [upper == length - punct, (upper == 1) & (length > 2), digit > 0, mark > 0, mark > 1, punct == length, punct > 0, np.isin(last, [44, 46, 59]), length <= 2, (length > 2) & (length <= 5), (length > 5) & (length <= 10), length > 10, np.minimum(length, 40) / 10, new],
        axis=1,
    ).astype(np.float32)
    x[filled, HASHED:] = np.add.reduceat(shape, starts, axis=0) / size
    return first, x


def _segments(values: np.ndarray, first: np.ndarray, op=np.add) -> np.ndarray:
    return op.reduceat(values, first[:-1], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and classifier; ``p`` holds the parameters."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"W": g(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "w": g(GATE), "c": g(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(first)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(_segments(e, first, np.maximum), n))
        a = e / np.repeat(_segments(e, first), n)
        z = _segments(a[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"][0])}

    def gradient(self, f: dict[str, np.ndarray], y: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(first)
        dy = (f["y"] - y) / len(y)
        dz = np.repeat(dy[:, None] * p["c"], n, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(_segments(f["a"] * da, first), n))
        dgate = de[:, None] * p["w"]
        dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dx, "b": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Model:
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            grad = self.gradient(self.forward(x, first), y, first)
            for k, q in self.p.items():
                g = grad[k] + decay * q
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                q -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        first, x = encode(texts)
        return self.forward(x, first)["y"]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in tk.slices(batch):
            first, x = encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], names=["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3_000, sample_passages: int = 200_000) -> Model:
    """Fit on docs(doc_id, text) with labels(doc_id, quality): rows with crc32(doc_id) mod 3 other than 1.

    The sample is bounded by two documented parameters: about ``sample_rows`` labelled ids, fewer where their passages (bytes / 128 + 1 each, 136 bytes of
    features a passage) would be more than ``sample_passages``.  Ids are picked by a hash, so a rerun fits on the same rows.
    """
    learn = crc_mod("doc_id", 3) != 1
    own = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 40))
    share = min(1.0, sample_rows / max(1, own.count()))

    def picked(part: float) -> DataFrame:
        mine = learn & (place < int(part * (1 << 40)))
        return docs.where(mine).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(own.where(mine), "doc_id")

    passages = picked(share).agg(F.sum(F.octet_length("text") / 128 + 1)).first()[0] or 0
    rows = picked(share * min(1.0, sample_passages / max(1.0, passages)))
    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(_examples, "doc_id long, quality int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["x"])))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]
    first = np.cumsum([0, *map(len, bags)])
    return Model().fit(np.concatenate(bags or [np.zeros((0, FEATURES))]).astype(np.float64), first, np.array([r["quality"] for r in got], float))


def score(docs: DataFrame, model: Model, columns: list[str] | None = None, name: str = "quality_score") -> DataFrame:
    """``columns`` of docs (all by default) with the score as column ``name``; a column of that name in the input gives way, as with ``withColumn``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*(c for c in (columns or docs.columns) if c.lower() != name.lower())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tk.slices(batch):
                kept = b.select(schema.names)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sent.value.score(b.column("text")))], names=[*schema.names, name])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(run, f"{ddl + ', ' if ddl else ''}`{name}` double")


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: doc_id, held_out, score, predicted."""
    tune(docs.sparkSession)
    model = train(docs, labels)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
