"""Language-model scoring by deleted interpolation of trigram, bigram, unigram and uniform estimates.

    P1(w)     = L1 * c(w) / N                +  (1 - L1) / (V + 1)
    P2(w|v)   = L2[c(v)] * c(v w) / c(v)     +  (1 - L2[c(v)]) * P1(w)
    P3(w|u v) = L3[c(u v)] * c(u v w) / c(u v) + (1 - L3[c(u v)]) * P2(w|v)

L2 and L3 have a weight for each bucket of log2 of the context's count (0 for a context never seen; a text's first token has no trigram).  All weights are
learned by expectation-maximisation on the counts of a deleted fold: the training rows with crc32(id) mod 5 = 0 are held out, and the estimates mixed
for them come from the other training rows.  The final scores use the counts of all training rows.

Looking up counts for each token of each document would shuffle one row a token.  Instead rows are folded to blocks of about ``block_bytes`` of text where they
are read, and the blocks, compressed, are a table in the shared folder.  A block asks once for each distinct token and bigram it holds; questions go to
shards by hash range as sorted arrays, with the block's own counts in them; a shard adds these up and answers in the same order.  A second round asks for
trigrams, but only for those whose two bigrams both occur in training rows of other blocks as well: for all others the block's own count is the count of the
corpus, so nothing is left out.  The shuffle follows distinct n-grams a block.  A shard's size follows the number of distinct n-grams, which hashing spreads
evenly, as long as a block has n-grams for most shards (up to some ten TB of text); beyond that its rows shrink to single n-grams.

Answers are tables in the shared folder, read by one job for the EM histogram and one for the scores.  The histogram (buckets and ratios of estimates
in quarter octaves) is bounded, whatever the input.

Defined results: null text is empty and scores its end token; a null id counts as the text '' for the folds; with no training row N = V = 0 and the
score is that of the uniform estimate; repeated ids and rows are scored as the rows they are; a text longer than a block is a block of its own; ties do not
matter to counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .common import crc_mod, table, tune

_END, _START = tk.U(0x0123456789ABCDEF), tk.U(0x7E57C0DE12345677)
_MIXED = tk.U(0x9DDFEA08EB382D69)
#: Text bytes for each shard: their questions take about as much.
SHARD_BYTES = 12 << 20
#: Steps of an octave in the EM histogram, and the mark of an estimate that is 0.
STEPS, NEVER = 4, -1000
_ANSWER = "block long, shard int, one binary, two binary, three binary, known long, tokens long, kept_tokens long, ratios array<int>, events array<long>"


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Monotone in the hash, so that a sorted array falls into consecutive slices."""
    return (((h >> tk.U(32)) * tk.U(shards)) >> tk.U(32)).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers, mostly small: a byte each, larger ones behind them, compressed."""
    large = x >= 255
    raw = np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype("<u8").tobytes()
    return len(x).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), int.from_bytes(b[8:16], "little")
    raw = pa.decompress(b[16:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as gaps, in as few bytes each as the largest gap takes, byte by byte of all."""
    gap = np.diff(h, prepend=tk.U(0))
    head, gap = gap[:1], gap[1:]
    width = (int(gap.max()).bit_length() + 7) // 8 if len(gap) else 0
    return bytes([width]) + head.tobytes() + np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    if len(b) == 1:
        return np.zeros(0, np.uint64)
    width, head = b[0], np.frombuffer(b, np.uint64, 1, 1)
    planes = np.frombuffer(b, np.uint8, offset=9).reshape(width, -1) if width else np.zeros((0, 0), np.uint8)
    gap = np.zeros((planes.shape[1], 8), np.uint8)
    gap[:, :width] = planes.T
    return np.cumsum(np.concatenate([head, gap.view(np.uint64).ravel()]))


@dataclass
class Tokens:
    """Tokens of a block: first[d]:first[d+1] are document d's, its end token last."""

    first: np.ndarray
    token: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    triple: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array | pa.ChunkedArray) -> Tokens:
        token, context, sizes = [], [], []
        for b in tk.slices(pa.record_batch([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], names=["text"])):
            w = tk.words(b.column(0), lower=True)
            t = np.insert(w.h, w.first[1:], _END)
            starts = w.first[:-1] + np.arange(w.n)
            c = np.empty_like(t)
            c[1:] = t[:-1]
            c[starts] = _START
            token.append(t)
            context.append(c)
            sizes.append(np.diff(w.first) + 1)
        none = [np.zeros(0, np.uint64)]
        t, c = np.concatenate(token or none), np.concatenate(context or none)
        first = np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))])
        pair = tk.mix(c * _MIXED + tk.rotated(t))
        return cls(first, t, c, pair, tk.mix(np.roll(pair, 1) * _MIXED + tk.rotated(t)))

    @property
    def opens(self) -> np.ndarray:
        """Whether a token is its text's first; its triple means nothing."""
        out = np.zeros(len(self.token), bool)
        out[self.first[:-1]] = True
        return out

    def each(self, per_doc: np.ndarray) -> np.ndarray:
        return np.repeat(per_doc, np.diff(self.first))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first[:-1]) if len(self.first) > 1 else np.zeros(0)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, fold) folded to blocks, each one compressed Arrow stream; a block's number is that of its partition and its place there."""
    held: list[pa.RecordBatch] = []
    size = number = 0
    task = TaskContext.get()
    part = task.partitionId() if task else 0

    def block() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([(part << 24) + number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

    for batch in batches:
        for b in tk.slices(batch):
            n = int(tk.buffers(b.column("text"))[1][-1])
            if held and size + n > block_bytes:
                yield block()
                held, size, number = [], 0, number + 1
            held.append(b)
            size += n
    if held:
        yield block()


def _docs(content: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(content.as_buffer()).read_all()


class Block:
    """A block's tokens, distinct n-grams and own counts: [n-gram, (all training rows, those outside the deleted fold)]."""

    def __init__(self, docs: pa.Table):
        self.docs = docs
        fold = docs.column("fold").to_numpy()
        self.fold = fold
        self.x = x = Tokens.of(docs.column("text"))
        self.train, self.kept = x.each((fold != 1).astype(float)), x.each((fold > 1).astype(float))

    def counted(self, h: np.ndarray, train: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct, place of each, counts, counts outside the fold)."""
        u, inverse = np.unique(h, return_inverse=True)
        return u, inverse, np.bincount(inverse, train, len(u)).astype(np.int64), np.bincount(inverse, kept, len(u)).astype(np.int64)

    def one(self):
        """Tokens, and a start for each text behind them."""
        starts = self.x.first[:-1]
        return self.counted(np.concatenate([self.x.token, np.full(len(starts), _START)]), np.concatenate([self.train, self.train[starts]]), np.concatenate([self.kept, self.kept[starts]]))

    def two(self):
        return self.counted(self.x.pair, self.train, self.kept)

    def elsewhere(self, two, answers: pa.Table) -> np.ndarray:
        """Places of tokens whose triple may occur in other blocks: both its bigrams do."""
        u, place, own, _ = two
        shared = (_read(answers, "two", 0) > own)[place]
        return np.flatnonzero(shared & np.roll(shared, 1) & ~self.x.opens)

    def three(self, at: np.ndarray):
        return self.counted(self.x.triple[at], self.train[at], self.kept[at])


def _asked(block: int, shards: int, **grams) -> pa.RecordBatch:
    """A row for each shard that the block has n-grams of, so rows never exceed distinct n-grams."""
    to = {name: shard_of(g[0], shards) for name, g in grams.items()}
    met = np.unique(np.concatenate(list(to.values())))
    cols: dict[str, list] = {}
    for name in ("one", "two", "three"):
        made: list[list] = [[], [], []]
        if name in grams:
            u, _, own, kept = grams[name]
            lo, hi = np.searchsorted(to[name], met), np.searchsorted(to[name], met, "right")
            for i, j in zip(lo.tolist(), hi.tolist()):
                for out, value in zip(made, (pack_sorted(u[i:j]), pack(own[i:j]), pack(kept[i:j]))):
                    out.append(value)
        for suffix, out in zip(("", "_all", "_kept"), made):
            cols[name + suffix] = pa.array(out or [None] * len(met), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(met), block)), pa.array(met.astype(np.int32)), *cols.values()], names=["block", "shard", *cols])


_ASKED = "block long, shard int, " + ", ".join(f"{n}{s} binary" for n in ("one", "two", "three") for s in ("", "_all", "_kept"))


def _ask_first(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, content in zip(batch.column("block").to_pylist(), batch.column("docs")):
            b = Block(_docs(content))
            yield _asked(number, shards, one=b.one(), two=b.two())


def _ask_triples(blocks: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
    b = Block(_docs(blocks.column("docs")[0]))
    return pa.Table.from_batches([_asked(blocks.column("block")[0].as_py(), shards, three=b.three(b.elsewhere(b.two(), answers)))])


def _answer(t: pa.Table) -> pa.Table:
    """A shard adds up what all blocks counted and answers each in its own order; one more row has its totals and the unigram events of the deleted fold."""
    blocks = t.column("block").to_pylist()
    n = len(blocks)
    out: dict[str, list] = {}
    known = tokens = kept_tokens = 0
    events: dict[int, int] = {}
    for name in ("one", "two", "three"):
        if t.column(name).null_count:
            out[name] = [None] * n
            continue
        asked = [unpack_sorted(x) for x in t.column(name).to_pylist()]
        cut = np.cumsum([0, *map(len, asked)])
        u, group = np.unique(np.concatenate(asked), return_inverse=True)
        sums = [np.bincount(group, np.concatenate([unpack(x) for x in t.column(f"{name}_{c}").to_pylist()]), len(u)).astype(np.int64) for c in ("all", "kept")]
        if name == "one":
            real = u != _START
            known, tokens, kept_tokens = int((sums[0][real] > 0).sum()), int(sums[0][real].sum()), int(sums[1][real].sum())
            level = _level(sums[1][real].astype(float))
            for k in np.unique(level).tolist():
                events[k] = int((sums[0] - sums[1])[real][level == k].sum())
        out[name] = []
        for i in range(n):
            g = group[cut[i] : cut[i + 1]]
            a, k = pack(sums[0][g]), pack(sums[1][g])
            out[name].append(len(a).to_bytes(8, "little") + a + k)
    shard = t.column("shard")[0].as_py()
    extra = [[None] * n + [list(events)], [None] * n + [list(events.values())]]
    return pa.table(
        [pa.array([*blocks, -1], pa.int64()), pa.array([shard] * (n + 1), pa.int32()), *(pa.array([*out[c], None], pa.binary()) for c in ("one", "two", "three")), *(pa.array([0] * n + [x]) for x in (known, tokens, kept_tokens)), pa.array(extra[0], pa.list_(pa.int32())), pa.array(extra[1], pa.list_(pa.int64()))],
        names=[c.split()[0] for c in _ANSWER.split(", ")],
    )


def _read(answers: pa.Table, name: str, which: int) -> np.ndarray:
    """Counts in the order of the block's sorted distinct n-grams; which: 0 of all training rows, 1 without the deleted fold."""
    own = answers.filter(answers.column(name).is_valid())
    rows = sorted(zip(own.column("shard").to_pylist(), own.column(name).to_pylist()))
    got = []
    for _, b in rows:
        n = int.from_bytes(b[:8], "little")
        got.append(unpack(b[8 + n :] if which else b[8 : 8 + n]))
    return np.concatenate(got) if got else np.zeros(0, np.int64)


@dataclass
class Totals:
    known: int
    tokens: int
    kept_tokens: int
    unigram: float = 0.5
    two: np.ndarray = field(default_factory=lambda: np.zeros(65))
    three: np.ndarray = field(default_factory=lambda: np.zeros(65))


def _bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2 c)."""
    return np.where(c > 0, np.frexp(np.maximum(c, 1).astype(float))[1], 0)


def _level(x: np.ndarray) -> np.ndarray:
    """log2 in steps of 1 / ``STEPS``; ``NEVER`` for 0."""
    return np.where(x > 0, np.round(STEPS * np.log2(np.maximum(x, 1e-300))), NEVER).astype(np.int32)


def _estimates(b: Block, answers: pa.Table, which: int, total: Totals) -> tuple[np.ndarray, ...]:
    """Per token: its count, P1, the bigram and trigram estimates (0 where the context is new), and both context buckets."""
    x = b.x
    u, place, *_ = b.one()
    one = _read(answers, "one", which)
    c, cv = one[place[: len(x.token)]], one[np.searchsorted(u, x.context)]
    two = b.two()
    pair = _read(answers, "two", which)[two[1]]
    cuv = np.roll(pair, 1)
    cuv[x.opens] = 0
    own = b.three(np.arange(len(x.token)))
    triple = own[3 if which else 2][own[1]]
    at = b.elsewhere(two, answers)
    triple[at] = _read(answers, "three", which)[np.unique(x.triple[at], return_inverse=True)[1]]
    triple[x.opens] = 0
    n = total.kept_tokens if which else total.tokens
    p1 = total.unigram * c / max(n, 1) + (1 - total.unigram) / (total.known + 1)
    return c, p1, pair / np.maximum(cv, 1), triple / np.maximum(cuv, 1), _bucket(cv), _bucket(cuv)


def _events(blocks: pa.Table, answers: pa.Table, total: Totals) -> pa.Table:
    """Histogram of the deleted fold's tokens by both context buckets and the ratios of both estimates to P1."""
    b = Block(_docs(blocks.column("docs")[0]))
    mine = b.x.each(b.fold == 0)
    _, p1, p2, p3, b2, b3 = (v[mine] for v in _estimates(b, answers, 1, total))
    shape = (65, 65, 4096, 4096)
    cell, n = np.unique(np.ravel_multi_index((b2, b3, _level(p2 / p1) + 2048, _level(p3 / p1) + 2048), shape), return_counts=True)
    b2, b3, r2, r3 = np.unravel_index(cell, shape)
    return pa.table([*(pa.array(c.astype(np.int32)) for c in (b2, b3, r2 - 2048, r3 - 2048)), pa.array(n.astype(np.int64))], names=["b2", "b3", "r2", "r3", "n"])


def em_weight(ratio: np.ndarray, n: np.ndarray, rounds: int = 200) -> float:
    """Weight of the first of two estimates from their ratios in n held-out events each."""
    w = 0.5
    for _ in range(rounds):
        now = float((n * (w * ratio / (w * ratio + 1 - w))).sum() / n.sum())
        now = min(max(now, 1e-6), 1 - 1e-6)
        if abs(now - w) < 1e-9:
            break
        w = now
    return w


def em_weights(bucket: np.ndarray, ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``em_weight`` of each context bucket; 0 for contexts never seen, and a bucket without events takes its lower neighbour's."""
    out = np.zeros(65)
    for b in range(1, 65):
        own = bucket == b
        out[b] = em_weight(ratio[own], n[own]) if own.any() else out[b - 1]
    return out


def learn(total: Totals, cells: np.ndarray) -> Totals:
    """Weights of bigrams, then, with those, of trigrams, from the histogram's rows (b2, b3, r2, r3, n)."""
    if len(cells):
        b2, b3, r2, r3, n = cells.T
        ratio = lambda r: np.where(r == NEVER, 0.0, 2.0 ** (r / STEPS))
        total.two = em_weights(b2, ratio(r2), n.astype(float))
        lower = total.two[b2] * ratio(r2) + 1 - total.two[b2]
        total.three = em_weights(b3, ratio(r3) / lower, n.astype(float))
    return total


def _score(blocks: pa.Table, answers: pa.Table, total: Totals) -> pa.Table:
    b = Block(_docs(blocks.column("docs")[0]))
    x, docs, n = b.x, b.docs, b.docs.num_rows
    c, p1, p2, p3, b2, b3 = _estimates(b, answers, 0, total)
    base = (c + 0.5) / (total.tokens + 0.5 * (total.known + 1))
    p2 = total.two[b2] * p2 + (1 - total.two[b2]) * p1
    p3 = total.three[b3] * p3 + (1 - total.three[b3]) * p2
    return pa.table(
        [docs.column("doc_id"), pa.array(b.fold == 1), pa.array(np.diff(x.first).astype(np.int64)), pa.array(x.sums((c > 0).astype(np.int64))), pa.array(np.full(n, total.tokens, np.int64)), pa.array(x.sums(np.log10(base))), pa.array(x.sums(np.log10(p3)))],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def fit(docs: DataFrame, block_bytes: int = 6 << 20) -> tuple[DataFrame, DataFrame, Totals]:
    """(blocks, answers, totals with the learned weights) of docs(doc_id, text), learned from rows whose crc32(doc_id) mod 5 is not 1."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), crc_mod("doc_id", 5).cast("int").alias("fold"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    blocks = table(rows.mapInArrow(lambda x: _blocks(x, block_bytes), "block long, docs binary"), "lm-blocks")
    asked = blocks.mapInArrow(lambda x: _ask_first(x, shards), _ASKED)
    first = table(asked.groupBy("shard").applyInArrow(_answer, _ANSWER), "lm-answers")
    known, tokens, kept = first.where("block = -1").agg(F.sum("known"), F.sum("tokens"), F.sum("kept_tokens")).first()
    total = Totals(known or 0, tokens or 0, kept or 0, 0.5 if tokens else 0.0)
    met = first.where("block = -1").select(F.explode(F.arrays_zip("ratios", "events")).alias("x")).groupBy("x.ratios").agg(F.sum("x.events")).collect()
    if sum(r[1] for r in met):
        level, n = (np.array(x, float) for x in zip(*met))
        share = np.where(level == NEVER, 0.0, 2.0 ** (level / STEPS)) / max(total.kept_tokens, 1)
        total.unigram = em_weight(share * (total.known + 1), n)
    by_block = lambda df: df.where("block >= 0").select("block", "shard", "one", "two", "three").groupBy("block")
    asked = blocks.groupBy("block").cogroup(by_block(first)).applyInArrow(lambda d, a: _ask_triples(d, a, shards), _ASKED)
    second = table(asked.groupBy("shard").applyInArrow(_answer, _ANSWER), "lm-triples")
    answers = first.unionByName(second)
    events = blocks.groupBy("block").cogroup(by_block(answers)).applyInArrow(lambda d, a: _events(d, a, total), "b2 int, b3 int, r2 int, r3 int, n long")
    cells = events.groupBy("b2", "b3", "r2", "r3").agg(F.sum("n").alias("n")).toArrow()
    return blocks, answers, learn(total, np.stack([cells.column(c).to_numpy().astype(np.int64) for c in ("b2", "b3", "r2", "r3", "n")], axis=1))


def lm_score(docs: DataFrame, block_bytes: int = 6 << 20) -> DataFrame:
    """Score every row of docs(doc_id, text); learn from rows whose crc32(doc_id) mod 5 is not 1."""
    blocks, answers, total = fit(docs, block_bytes)
    mine = answers.where("block >= 0").select("block", "shard", "one", "two", "three").groupBy("block")
    return blocks.groupBy("block").cogroup(mine).applyInArrow(lambda d, a: _score(d, a, total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
