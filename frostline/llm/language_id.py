"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text's letters-only runs are padded with a space; the model predicts each character and the closing space from up
to ``ORDER - 1`` characters before it inside the padded run.  Counting is a Spark aggregation over all training rows: each
task folds its texts to distinct runs first, then to distinct n-grams, so what is shuffled follows the number of distinct n-grams.
The highest order uses counts, lower orders continuation counts (n-grams that open a run keep counts).

Inverse temperature and rejection limits come from all distinct texts of a fold, a fifth of the training rows, scored by the model of the other rows; they are
sums and order statistics made in Spark.  The query then predicts with a model of all training rows and these figures.

No n-gram is left out.  Continuation counts, context totals, discounts and the interpolated log probability of each n-gram under every language
are made in Spark, one order after the other.  A model of at most ``broadcast_numbers`` numbers is sent to all tasks; for a larger one documents are
dealt to blocks by a hash, a block asks once for each distinct n-gram it holds, and its rows are scored with the part of the model it got,
so both ways give the same figures.

Defined results: null texts and texts without a letter give ``und`` with score 0; rows with null lang are predicted, not learned from;
rows that repeat are learned from and predicted as the rows they are; of languages with equal probability the first by name is named; a text of any length is
read whole; extra columns, whatever their names, are ignored; with no training row at all, every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textkernel as tk
from .common import crc_mod, table, tune

ORDER = 5
#: Distinct runs a task holds before it counts their n-grams.
FLUSH_RUNS = 200_000
#: One training row in so many is in the fold that calibrates.
FOLDS = 5
#: Inverse temperatures among which calibration chooses.
BETAS = 2.0 ** np.arange(-1, 7, 0.5)
#: Share of a language's known texts that its rejection limit lies above, before half a bit is added.
TAIL = 0.999
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[np.r_[65:91, 97:123, 128:256]] = False
_SCHEMA = "lang string, n int, h long, suffix long, context long, opens boolean, c long"


def _runs(texts: pa.Array) -> tuple[tk.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words made of letters, and the distinct ones: (words, index of a first occurrence, inverse, distinct hashes)."""
    data, off = tk.buffers(texts)
    data = tk._LOWER[data]
    data = np.where(_NO_LETTER[data], np.uint8(32), data)
    wide = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    w = tk.words(wide)
    u, at, inverse = np.unique(w.h, return_index=True, return_inverse=True)
    return w, at, inverse, u


def _strings(w: tk.Words, at: np.ndarray) -> list[str]:
    raw = w.data.tobytes()
    return [raw[s:e].decode("utf-8", "replace").lower() for s, e in zip(w.start[at].tolist(), w.end[at].tolist())]


def _padded(runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of ' run run ... run ', position of each predicted character's opening space, its run)."""
    code = np.frombuffer((" " + " ".join(runs) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, runs), np.int64, len(runs)) + 1
    opening = np.cumsum(lengths) - lengths
    return code, np.repeat(opening, lengths), np.repeat(np.arange(len(runs)), lengths)


def _grams(code: np.ndarray, opening: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which predicted characters (position i + 1) have an n-gram inside their run, and the hash that ends there."""
    ends = np.arange(1, len(code))
    ok = ends - n + 1 >= opening
    return ok, tk.rolling(tk.mix(code + tk.U(0x51ED2701)), n)[np.maximum(ends - n + 1, 0)[ok]]


def _count(lang: str, runs: list[str], weight: np.ndarray) -> pa.RecordBatch:
    code, opening, run = _padded(runs)
    weight = weight[run]
    ends = np.arange(1, len(code))
    cols: list[list[np.ndarray]] = []
    base = tk.mix(code + tk.U(0x51ED2701))
    hashes = {n: tk.rolling(base, n) for n in range(1, ORDER + 1)}
    for n in range(1, ORDER + 1):
        ok = ends - n + 1 >= opening
        first = ends[ok] - n + 1
        h = hashes[n][first]
        u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(inverse, weight[ok], len(u)).astype(np.int64)
        first = first[at]
        suffix = hashes[n - 1][first + 1] if n > 1 else np.zeros(len(u), np.uint64)
        context = hashes[n - 1][first] if n > 1 else np.zeros(len(u), np.uint64)
        opens = first == opening[ends[ok][at] - 1]
        cols.append([np.full(len(u), n, np.int32), u.view(np.int64), suffix.view(np.int64), context.view(np.int64), opens, c])
    joined = [np.concatenate(x) for x in zip(*cols)]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(joined[0]), pa.string()), *map(pa.array, joined)], names=["lang", "n", "h", "suffix", "context", "opens", "c"])


def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to n-gram counts of each language met."""
    held: dict[str, dict[str, int]] = {}
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            own = batch.filter(pc.equal(batch.column("lang"), lang))
            for b in tk.slices(own, limit=4 * tk.SLICE_BYTES):
                w, at, inverse, u = _runs(b.column("text"))
                n = np.bincount(inverse, minlength=len(u)).tolist()
                mine = held.setdefault(lang, {})
                for run, c in zip(_strings(w, at), n):
                    mine[run] = mine.get(run, 0) + c
                if len(mine) > FLUSH_RUNS:
                    yield _count(lang, list(mine), np.fromiter(mine.values(), np.int64, len(mine)))
                    held[lang] = {}
    for lang, mine in held.items():
        if mine:
            yield _count(lang, list(mine), np.fromiter(mine.values(), np.int64, len(mine)))


class Model:
    """Per order: sorted n-gram hashes with log2 probabilities under each language; contexts with log2 back-off weights."""

    def __init__(self, langs: list[str]):
        self.langs, self.grams, self.back = langs, {}, {}
        self.beta, self.reject = 1.0, np.full(len(langs), np.inf)
        #: Rows (n, h, v) of a model that is too large to broadcast.
        self.entries: DataFrame | None = None

    def part(self, entries: pa.Table) -> Model:
        """The model with these rows (n, h, v) as its arrays; those of contexts have -n."""
        out = Model(self.langs)
        out.beta, out.reject = self.beta, self.reject
        entries = entries.combine_chunks()
        n, h = entries.column("n").to_numpy(), entries.column("h").to_numpy().view(np.uint64)
        v = entries.column("v").combine_chunks() if entries.num_rows else pa.array([], pa.list_(pa.float32()))
        v = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(entries.num_rows, len(self.langs))
        for order in range(1, ORDER + 1):
            for held, sign in ((out.grams, 1), (out.back, -1)):
                own = np.flatnonzero(n == sign * order)
                own = own[np.argsort(h[own])]
                held[order] = (h[own], v[own])
        return out

    def bits(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability of each run under each language, and the characters predicted."""
        code, opening, run = _padded(runs)
        base, ends = tk.mix(code + tk.U(0x51ED2701)), np.arange(1, len(code))
        hashes = {n: tk.rolling(base, n) for n in range(1, ORDER + 1)}
        got = np.zeros((len(ends), len(self.langs)), np.float32)
        n_of = np.minimum(ends - opening + 1, ORDER)
        for n in range(ORDER, 0, -1):
            todo = np.flatnonzero(n_of == n)
            if not len(todo):
                continue
            first = ends[todo] - n + 1
            h = hashes[n][first]
            keys, p = self.grams[n]
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            got[todo[hit]] += p[at[hit]]
            miss = todo[~hit]
            if n == 1:
                got[miss] -= 11
            elif len(miss):  # unseen: weigh by the context and go on with the shorter n-gram
                context, gamma = self.back[n]
                c = hashes[n - 1][first[~hit]]
                at = np.minimum(np.searchsorted(context, c), max(len(context) - 1, 0))
                known = context[at] == c if len(context) else np.zeros(len(c), bool)
                got[miss[known]] += gamma[at[known]]
                n_of[miss] = n - 1
        edges = np.flatnonzero(np.diff(run, prepend=-1))
        return np.add.reduceat(got, edges, axis=0, dtype=np.float64), np.bincount(run)

    def entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language (inf where no letter), and characters."""
        w, at, inverse, u = _runs(texts)
        out = np.full((w.n, len(self.langs)), np.inf)
        size = np.zeros(w.n)
        if len(u) and self.langs:
            bits, chars = self.bits(_strings(w, at))
            size = w.sums(chars[inverse]).astype(float)
            some = size > 0
            for i in range(len(self.langs)):
                out[some, i] = -w.sums(bits[inverse, i])[some] / size[some]
        return out, size

    def confidence(self, entropy: np.ndarray, beta: float | None = None) -> np.ndarray:
        """Softmax of the negative entropies times ``beta``, the calibrated one if none is given; rows without letters give 0."""
        ok = np.isfinite(entropy).all(axis=1) & (entropy.shape[1] > 0)
        p = np.zeros_like(entropy)
        if ok.any():
            z = -(self.beta if beta is None else beta) * entropy[ok]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p[ok] = z / z.sum(axis=1, keepdims=True)
        return p


def calibrate(model: Model, known: DataFrame) -> None:
    """Inverse temperature by likelihood, and each language's entropy beyond which a text counts as rejected, from all distinct rows of known(lang, text).

    Only a sum for each of ``BETAS`` and two order statistics a language come to the driver.
    """
    # equal texts have equal figures, so they are told apart by 128 bits and never shuffled
    keyed = known.select("lang", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit("second")).alias("k2"), "text")
    rows = table(_apply(keyed, model, _known, "l int, k1 long, k2 long, own double, fits array<long>").dropDuplicates(["l", "k1", "k2"]), "kn-calibration")
    met = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col("fits")[i]) for i in range(len(BETAS)))).alias("fits")).collect()
    if not met:
        return
    model.beta = float(BETAS[np.argmax(np.sum([r["fits"] for r in met], axis=0))])
    # a quantile lies between two places of the ascending order, so near the top that few rows are ranked
    at = {r["l"]: (r["n"] - int(TAIL * (r["n"] - 1)), TAIL * (r["n"] - 1) % 1) for r in met}
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("own")))
    top = rows.select("l", "own", rank.alias("rank")).where(F.col("rank") <= max(k for k, _ in at.values()))
    wanted = reduce(lambda x, y: x | y, ((F.col("l") == i) & F.col("rank").between(k - 1, k) for i, (k, _) in at.items()))
    found = {(r["l"], r["rank"]): r["own"] for r in top.where(wanted).collect()}
    for i, (k, share) in at.items():
        low = found[i, k]
        model.reject[i] = low + (found.get((i, k - 1), low) - low) * share + 0.5


def estimate(counted: DataFrame, langs: list[str]) -> DataFrame:
    """(n, h, v): log2 probability of each n-gram under every language, and as (-n, context, v) the log2 back-off weights."""
    spark, count = counted.sparkSession, len(langs)
    known = F.broadcast(spark.createDataFrame(list(enumerate(langs)), "l int, lang string"))
    counted = counted.join(known, "lang").drop("lang")
    # continuation counts, but for n-grams that open a run
    cont = counted.where("n > 1").groupBy("l", (F.col("n") - 1).alias("n"), F.col("suffix").alias("h")).agg(F.count(F.lit(1)).alias("cont"))
    c = F.when(F.col("opens") | F.col("cont").isNull(), F.col("c")).otherwise(F.col("cont")).cast("double")
    counted = table(counted.join(cont, ["l", "n", "h"], "left").select("l", "n", "h", "suffix", "context", c.alias("c")), "kn-adjusted")
    met = counted.groupBy("l", "n").agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()
    discounts = [(r["l"], r["n"], min(max(r["once"] / max(r["once"] + 2 * r["twice"], 1), 0.1), 0.9)) for r in met]
    counted = counted.join(F.broadcast(spark.createDataFrame(discounts, "l int, n int, d double")), ["l", "n"])
    by_lang = lambda x: F.map_from_entries(F.collect_list(F.struct("l", x)))
    of = lambda m, l, none: F.coalesce(F.try_element_at(F.col(m), l), F.lit(none))  # noqa: E731, E741
    each = F.sequence(F.lit(0), F.lit(count - 1))
    log = lambda x: F.transform(x, lambda y: F.log2(y).cast("float"))
    lower, out = None, []
    for n in range(1, ORDER + 1):
        mine = counted.where(F.col("n") == n)
        total = mine.groupBy("context", "l").agg(F.sum("c").alias("total"), (F.first("d") * F.count(F.lit(1)) / F.sum("c")).alias("gamma"))
        total = total.groupBy("context").agg(by_lang("total").alias("total"), by_lang("gamma").alias("gamma"))
        total = table(total, f"kn-context-{n}")
        grams = mine.groupBy("h").agg(F.first("suffix").alias("suffix"), F.first("context").alias("context"), by_lang((F.col("c") - F.col("d")).alias("s")).alias("seen"))
        grams = grams.join(total, "context")
        if lower is None:
            grams = grams.withColumn("below", F.array_repeat(F.lit(1 / 2048), count))
        else:
            grams = grams.join(lower.select(F.col("h").alias("suffix"), F.col("p").alias("below")), "suffix")
        p = F.transform(each, lambda l: of("seen", l, 0.0) / of("total", l, 1.0) + of("gamma", l, 1.0) * F.element_at("below", l + 1))  # noqa: E741
        lower = table(grams.select("h", p.alias("p")), f"kn-order-{n}")
        out.append(lower.select(F.lit(n).alias("n"), "h", log("p").alias("v")))
        # an unseen context passes all its mass on
        out.append(total.select(F.lit(-n).alias("n"), F.col("context").alias("h"), log(F.transform(each, lambda l: of("gamma", l, 1.0))).alias("v")))  # noqa: E741
    return reduce(DataFrame.unionByName, out)


def held_for_calibration(every: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("calibration")), F.lit(every)) == 0


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.select("lang", F.coalesce("text", F.lit("")).alias("text")).where(F.col("lang").isNotNull())


def _summed(grams: DataFrame, name: str) -> DataFrame:
    return table(grams.groupBy("lang", "n", "h").agg(F.first("suffix").alias("suffix"), F.first("context").alias("context"), F.first("opens").alias("opens"), F.sum("c").alias("c")), name)


def _fitted(counted: DataFrame, broadcast_numbers: int) -> Model:
    model = Model(sorted(r["lang"] for r in counted.where("n = 1").select("lang").distinct().collect()))
    if not model.langs:
        return model
    entries = estimate(counted, model.langs)
    if entries.count() * len(model.langs) <= broadcast_numbers:
        return model.part(entries.toArrow())
    model.entries = entries
    return model


def _outside(docs: DataFrame, broadcast_numbers: int) -> tuple[Model, DataFrame]:
    """(calibrated model of the rows outside the fold, their counts)."""
    rows, fold = _labelled(docs), held_for_calibration(FOLDS)
    counted = _summed(rows.where(~fold).mapInArrow(count_ngrams, _SCHEMA), "kn-grams")
    model = _fitted(counted, broadcast_numbers)
    if model.langs:
        calibrate(model, rows.where(fold))
    return model, counted


def train(docs: DataFrame, broadcast_numbers: int = 8_000_000) -> Model:
    """Model from docs(lang, text): a fifth of the rows, picked by a hash of the text, calibrates it and is left out of its counts."""
    return _outside(docs, broadcast_numbers)[0]


def train_whole(docs: DataFrame, broadcast_numbers: int = 8_000_000) -> Model:
    """Model that counts every row of docs(lang, text), with the temperature and limits that ``train`` finds; a language met in the fold alone has no limit."""
    known, counted = _outside(docs, broadcast_numbers)
    rest = _labelled(docs).where(held_for_calibration(FOLDS)).mapInArrow(count_ngrams, _SCHEMA)
    model = _fitted(_summed(counted.unionByName(rest), "kn-whole"), broadcast_numbers)
    model.beta = known.beta
    limits = dict(zip(known.langs, known.reject))
    model.reject = np.array([limits.get(x, np.inf) for x in model.langs], float)
    return model


def _known(m: Model, b: pa.RecordBatch) -> pa.RecordBatch:
    """The entropy of each text with letters under its own language, and millionths of its log likelihood at each of ``BETAS``, whose sums are exact in any order."""
    e, size = m.entropy(b.column("text"))
    index = {x: i for i, x in enumerate(m.langs)}
    t = np.array([index.get(x, -1) for x in b.column("lang").to_pylist()], np.int32)
    ok = np.flatnonzero((t >= 0) & (size > 0))
    e, t = e[ok], t[ok]
    each = np.arange(len(t))
    fits = np.stack([np.rint(1e6 * np.log(np.maximum(m.confidence(e, beta)[each, t], 1e-12))) for beta in BETAS], axis=1).astype(np.int64)
    kept = b.take(pa.array(ok))
    return pa.RecordBatch.from_arrays([pa.array(t), kept.column("k1"), kept.column("k2"), pa.array(e[each, t]), pa.array(list(fits), pa.list_(pa.int64()))], names=["l", "k1", "k2", "own", "fits"])


def _asked(t: pa.Table) -> pa.Table:
    """Distinct n-grams (n, h) and contexts (-n, h) of a block."""
    runs: set[str] = set()
    for b in tk.slices(t.select(["text"]).combine_chunks().to_batches()[0]):
        w, at, _, _ = _runs(b.column("text"))
        runs.update(_strings(w, at))
    ns, hs = [], []
    if runs:
        code, opening, _ = _padded(list(runs))
        base, ends = tk.mix(code + tk.U(0x51ED2701)), np.arange(1, len(code))
        hashes = {n: tk.rolling(base, n) for n in range(1, ORDER + 1)}
        for n in range(1, ORDER + 1):
            first = ends[ends - n + 1 >= opening] - n + 1
            for sign, h in ((1, hashes[n][first]), *([(-1, hashes[n - 1][first])] if n > 1 else [])):
                hs.append(np.unique(h).view(np.int64))
                ns.append(np.full(len(hs[-1]), sign * n, np.int32))
    n, h = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((ns, np.int32), (hs, np.int64)))
    return pa.table([pa.array(np.full(len(n), t.column("block")[0].as_py(), np.int32)), pa.array(n), pa.array(h)], names=["block", "n", "h"])


def _apply(docs: DataFrame, model: Model, make: Callable[[Model, pa.RecordBatch], pa.RecordBatch], schema: str, block_bytes: int = 16 << 20) -> DataFrame:
    """make(model, rows) on all rows of docs, which has a text: with the model broadcast, or block by block with the n-grams that the block asked for."""
    if model.entries is None:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in tk.slices(batch, limit=4 * tk.SLICE_BYTES):
                    yield make(sent.value, b)

        return docs.mapInArrow(run, schema)
    entries, names = model.entries, docs.columns
    head = Model(model.langs)
    head.beta, head.reject = model.beta, model.reject
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int"))
    asked = rows.select("block", F.coalesce("text", F.lit("")).alias("text")).groupBy("block").applyInArrow(_asked, "block int, n int, h long")
    answers = asked.join(entries, ["n", "h"])

    def score(d: pa.Table, a: pa.Table) -> pa.Table:
        m = head.part(a)
        d = d.select(names).combine_chunks()
        return pa.Table.from_batches([make(m, b) for whole in d.to_batches() for b in tk.slices(whole, limit=4 * tk.SLICE_BYTES)] or [make(m, pa.RecordBatch.from_pylist([], d.schema))])

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def _predictions(m: Model, b: pa.RecordBatch) -> pa.RecordBatch:
    names = np.array([*m.langs, "und"], object)
    e, size = m.entropy(b.column("text"))
    n = b.num_rows
    none = size == 0
    data, off = tk.buffers(b.column("text"))
    ascii_letters = np.concatenate([[0], np.cumsum(~_NO_LETTER[data] & (data < 128), dtype=np.int64)])[off]
    for i in np.flatnonzero(~none & (np.diff(ascii_letters) == 0)):  # bytes over 127 may be symbols: look only where no ASCII letter is
        none[i] = not any(c.isalpha() for c in b.column("text")[int(i)].as_py())
    p = m.confidence(e)
    best = np.where(none, len(m.langs), p.argmax(axis=1) if m.langs else 0)
    score = np.where(none, 0.0, p.max(axis=1) if m.langs else 0.0)
    least = e[np.arange(n), np.minimum(best, max(len(m.langs) - 1, 0))] if m.langs else np.full(n, np.inf)
    limit = np.append(m.reject, -np.inf)[best]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array([None if z else x for x, z in zip(least.tolist(), none)], pa.float64()), pa.array(none | (least > limit))], names=["doc_id", "lang_pred", "score", "bits_per_char", "rejected"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_char, rejected for docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _apply(rows, model, _predictions, "doc_id long, lang_pred string, score double, bits_per_char double, rejected boolean")


def language_id(docs: DataFrame, **options) -> DataFrame:
    """The registered query: learn where crc32(doc_id) mod 5 is not 0, predict every row."""
    tune(docs.sparkSession)
    held = crc_mod("doc_id", 5) == 0
    model = train_whole(docs.where(~held), **options)
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")
