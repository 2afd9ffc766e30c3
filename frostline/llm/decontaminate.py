"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of passages.

The n-grams of ``SEED`` words of all test items are seeds.  Their frequency in the corpus is counted.  A seed is rare, and kept, if it occurs at most
``RARE`` times or at most ``NEAR_LEAST`` times as often as the least frequent one found in a stretch of ``STRETCH`` consecutive seeds around it: common phrases are
left out where a rarer one is near, but every part of an item keeps its seeds however often the item was copied.  Seeds that the corpus has not join nothing.  Training passages are joined with items on seed hashes.  Seed hits of one
document and item that lie near one diagonal form a passage, and a local alignment of the words (match 2, mismatch -1,
gap -1) scores it, so edited and paraphrased copies with changed, lost or added words still align.

score = best alignment score / (2 * words of the item); a document is contaminated by an item at ``threshold`` or more.
Equal passages are aligned once a batch.  Seeds and items are two tables.  They follow the benchmark: both are sized, and broadcast up to
``broadcast_seeds`` seeds and ``broadcast_words`` words; a larger benchmark is joined by shuffling the seed hashes of the documents that pass a
bitmap of all seeds (fixed size) instead, and each document meets its items in one row.
Both ways count occurrences, keep the same seeds and align around the kept ones only, so their results are equal.

Words are lower-cased (A-Z) and stripped of outer ASCII punctuation.  Items with fewer than ``SEED`` words use all their words as
one seed and must match it whole.  Null texts and items have no words and match nothing; of repeated ids each row counts; of equally good passages of a document
the first is reported; items and texts may have any length; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .common import table, tune

SEED, STRETCH = 4, 6
RARE, NEAR_LEAST = 64, 8
_FILLER = np.array([32 if b < 128 and not chr(b).isalnum() else b for b in range(256)], np.uint8)


def clean_words(texts: pa.Array) -> tk.Words:
    """Lower-cased words; ASCII punctuation counts as a separator."""
    data, off = tk.buffers(texts)
    data = _FILLER[tk._LOWER[data]]
    return tk.words(pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items and the hashes of their words."""
    for batch in batches:
        for b in tk.slices(batch):
            w = clean_words(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([w.h[i:j].tobytes() for i, j in zip(w.first[:-1], w.first[1:])], pa.binary())], names=["item_id", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All seeds of items: (item, at, seed)."""
    for b in batches:
        for item, words in zip(b.column("item").to_pylist(), b.column("words")):
            h = np.frombuffer(words.as_buffer(), np.uint64)
            g = tk.rolling(h, min(SEED, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), item)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g.view(np.int64))], names=["item", "at", "seed"])


class Lookup:
    """Sorted distinct seeds with a bitmap in front."""

    def __init__(self, seeds: np.ndarray):
        self.seeds = np.unique(seeds)
        #: Bits of a hash that the bitmap tells apart: 16 places a seed, up to a million.
        self.shift = tk.U(64 - min(20, max(4, (16 * len(self.seeds)).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(self.seeds >> self.shift).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(self.bits[(g >> self.shift).astype(np.int64)])
        if not len(some) or not len(self.seeds):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, g[some]), len(self.seeds) - 1)
        return some[self.seeds[at] == g[some]]


def _seeds_of(w: tk.Words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    parts = [tk.windows(w, k) for k in sizes]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman on word hashes: (best score, first and behind-last word of b near it).

    Rows are words of a.  Gaps along b within a row are resolved by a running maximum of score + position, so a row is a few NumPy operations.
    """
    m = len(b)
    pos = np.arange(1, m + 1)
    before = np.zeros(m + 1, np.int64)
    best, where = 0, 0
    for x in a:
        diag = before[:-1] + np.where(b == x, 2, -1)
        row = np.maximum(np.maximum(diag, before[1:] - 1), 0)
        row = np.maximum.accumulate(row + pos) - pos
        top = int(row.argmax())
        if row[top] > best:
            best, where = int(row[top]), top + 1
        before[1:] = row
    return best, max(0, where - len(a)), where


def _passages(w: tk.Words, doc: np.ndarray, at: np.ndarray, item: np.ndarray, item_at: np.ndarray, items: dict[int, np.ndarray], known: dict) -> list[tuple[int, int, int, float, int, int]]:
    """Best alignment of each (document, item) with seed hits: (document, item, hits, score, first word, behind last)."""
    out = []
    order = np.lexsort((at, item, doc))
    doc, at, item, item_at = doc[order], at[order], item[order], item_at[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True]]))
    for s, e in zip(edge[:-1], edge[1:]):
        d, i = int(doc[s]), int(item[s])
        a = items[i]
        first, last = w.first[d], w.first[d + 1]
        begin = at[s:e] - item_at[s:e]  # where the item would start
        begin = np.sort(begin)
        jump = np.flatnonzero(np.diff(begin) > len(a) // 2 + 1)
        best = (0.0, 0, 0)
        for lo, hi in zip(np.concatenate([[0], jump + 1]), np.concatenate([jump, [len(begin) - 1]])):
            x = max(first, begin[lo] - len(a) // 4 - 2)
            y = min(last, begin[hi] + len(a) + len(a) // 4 + 2)
            b = w.h[x:y]
            key = (i, b.tobytes())
            if key not in known:
                score, p, q = align(a, b)
                known[key] = (score / (2 * len(a)), p, q)
            score, p, q = known[key]
            if score > best[0]:
                best = (score, int(x + p - first), int(x + q - first))
        out.append((d, i, int(e - s), *best))
    return out


def _scan(batches: Iterator[pa.RecordBatch], seeds: np.ndarray, item: np.ndarray, item_at: np.ndarray, items: dict[int, np.ndarray], item_ids: list, threshold: float) -> Iterator[pa.RecordBatch]:
    order = np.argsort(seeds, kind="stable")
    seeds, item, item_at = seeds[order], item[order], item_at[order]
    lookup = Lookup(seeds)
    sizes = sorted({min(SEED, len(x)) for x in items.values()})
    known: dict = {}
    for batch in batches:
        for b in tk.slices(batch):
            if len(known) > 20_000:
                known.clear()
            w = clean_words(b.column("text"))
            at, g = _seeds_of(w, sizes)
            hit = lookup.hits(g)
            at, g = at[hit], g[hit]
            lo, hi = np.searchsorted(seeds, g), np.searchsorted(seeds, g, "right")
            n = hi - lo
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            found = _passages(w, np.searchsorted(w.first, at, "right") - 1, at, item[entry], item_at[entry], items, known) if len(at) else []
            found = [x for x in found if x[3] >= threshold]
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[x[0]].as_py() for x in found], pa.int64()), pa.array([item_ids[x[1]] for x in found], pa.int64()), *(pa.array([x[k] for x in found], t) for k, t in ((2, pa.int32()), (3, pa.float64()), (4, pa.int32()), (5, pa.int32())))],
                names=["doc_id", "item_id", "seed_hits", "score", "first_word", "end_word"],
            )


_FOUND = "doc_id long, item_id long, seed_hits int, score double, first_word int, end_word int"


def benchmark_tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, words) with words, and their seeds (item, at, seed); rows of one id with equal words are one item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = rows.mapInArrow(_item_words, "item_id long, words binary").where(F.length("words") > 0).distinct()
    # numbered once in a table: the number is the item's key everywhere
    items = table(words.withColumn("item", F.monotonically_increasing_id()), "dc-items")
    return items, table(items.select("item", "words").mapInArrow(_item_seeds, "item long, at int, seed long"), "dc-seeds")


def rare(n: np.ndarray) -> np.ndarray:
    """Which of an item's consecutive seeds are kept, from their corpus frequencies."""
    none = np.iinfo(np.int64).max // (2 * NEAR_LEAST)
    f = np.where(n == 0, none, n)
    width = min(STRETCH, len(f))
    least = tk.sliding(f, width)
    pad = np.zeros(width - 1, np.int64)
    around = tk.sliding(np.concatenate([pad, np.where(least == none, 0, least), pad]), width, np.maximum)
    return (n > 0) & (n <= np.maximum(RARE, NEAR_LEAST * around))


def _rare_rows(t: pa.Table) -> pa.Table:
    """The seeds of one item that are kept."""
    t = t.sort_by("at")
    return t.filter(pa.array(rare(t.column("n").to_numpy()))).select(["item", "seed", "at"])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, broadcast_seeds: int = 200_000, broadcast_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, seed_hits, score, first_word, end_word) of every contaminated document and item."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items, seeds = benchmark_tables(benchmark)
    total = items.agg(F.coalesce(F.sum(F.length("words") / 8), F.lit(0)).alias("words")).first()["words"]
    if total == 0:
        return spark.createDataFrame([], _FOUND)
    if total > broadcast_words or seeds.count() > broadcast_seeds:
        return _joined(rows, items, seeds, threshold)
    own = items.orderBy("item").toArrow()
    number = {x: i for i, x in enumerate(own.column("item").to_pylist())}
    names, words = own.column("item_id").to_pylist(), {i: np.frombuffer(x.as_buffer(), np.uint64) for i, x in enumerate(own.column("words"))}
    got = seeds.orderBy("item", "at").toArrow()
    item = np.array([number[x] for x in got.column("item").to_pylist()], np.int64)
    at, seed = got.column("at").to_numpy().astype(np.int64), got.column("seed").to_numpy().view(np.uint64)
    sizes = sorted({min(SEED, len(x)) for x in words.values()})
    lookup = spark.sparkContext.broadcast(np.unique(seed))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(lookup.value)
        total = np.zeros(len(look.seeds), np.int64)
        for batch in batches:
            for b in tk.slices(batch):
                g = _seeds_of(clean_words(b.column("text")), sizes)[1]
                g = g[look.hits(g)]
                total += np.bincount(np.searchsorted(look.seeds, g), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(look.seeds[some].view(np.int64)), pa.array(total[some])], names=["seed", "n"])

    frequency = {r["seed"]: r["n"] for r in rows.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()}
    n = np.array([frequency.get(int(x), 0) for x in seed.view(np.int64)], np.int64)
    keep = np.zeros(len(seed), bool)
    cut = np.searchsorted(item, np.arange(len(names) + 1))
    for i, j in zip(cut[:-1], cut[1:]):
        keep[i:j] = rare(n[i:j])
    sent = spark.sparkContext.broadcast((seed[keep], item[keep], at[keep], words, names))
    return rows.mapInArrow(lambda x: _scan(x, *sent.value, threshold), _FOUND)


#: log2 of the bits in the bitmap of a large benchmark's seeds: 16 MB whatever the benchmark.
BITMAP = 27


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit for each value of the upper ``BITMAP`` bits of the seeds; made by an aggregation, so at most 2**BITMAP / 64 rows come to the driver."""
    place = F.shiftrightunsigned("seed", 64 - BITMAP)
    rows = seeds.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _joined(rows: DataFrame, items: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """For benchmarks too large to broadcast: the documents' seed hashes are shuffled to the items' seeds, then items to the documents they hit."""
    sizes = [r[0] for r in items.select(F.least(F.lit(SEED), (F.length("words") / 8).cast("int"))).distinct().collect()]
    bitmap = rows.sparkSession.sparkContext.broadcast(seed_bitmap(seeds))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for b in tk.slices(batch):
                w = clean_words(b.column("text"))
                at, g = _seeds_of(w, sizes)
                place = g >> tk.U(64 - BITMAP)
                some = (bits[(place >> tk.U(6)).astype(np.int64)] >> (place & tk.U(63))) & tk.U(1) > 0
                at, g = at[some], g[some]
                doc = np.searchsorted(w.first, at, "right") - 1
                pair, n = np.unique(np.stack([doc.astype(np.uint64), g]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(pair[0].astype(np.int64))), pa.array(pair[1].view(np.int64)), pa.array(n.astype(np.int64))], names=["row", "seed", "n"])

    # rows are joined by a hash of all they have, so null and repeated ids count; a collision only adds a candidate that scores nothing
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    hashes = table(rows.select("row", "text").mapInArrow(emit, "row long, seed long, n long").join(seeds.select("seed").distinct(), "seed", "left_semi"), "dc-hits")
    counted = hashes.groupBy("seed").agg(F.sum("n").alias("n"))
    found = seeds.join(counted, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kept = table(found.groupBy("item").applyInArrow(_rare_rows, "item long, seed long, at int"), "dc-rare")
    of_item = items.join(kept.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", "seed"))).alias("kept")), "item")
    pairs = hashes.select("row", "seed").join(kept.select("seed", "item").distinct(), "seed").select("row", "item").distinct()
    of_row = pairs.join(of_item, "item").groupBy("row").agg(F.collect_list(F.struct("item_id", "words", F.col("kept.seed").alias("seeds"), F.col("kept.at").alias("ats"))).alias("items"))
    both = rows.join(of_row, "row")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                own = b.column("items").flatten()
                g, at = (own.field(c).flatten().to_numpy().astype(np.int64) for c in ("seeds", "ats"))
                item = np.repeat(np.arange(len(own)), np.diff(own.field("seeds").offsets.to_numpy()))
                words = {k: np.frombuffer(x.as_buffer(), np.uint64) for k, x in enumerate(own.field("words"))}
                yield from _scan([b.select(["doc_id", "text"])], g.view(np.uint64), item, at, words, own.field("item_id").to_pylist(), threshold)

    return both.select("doc_id", "text", "items").mapInArrow(score, _FOUND)


def decontamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The registered query: contaminated (doc_id, item_id) with their score and place."""
    return contaminated(docs, benchmark, **options).withColumn("score", F.round("score", 6))
