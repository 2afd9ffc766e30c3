"""Substring dedup: recurring passages are confirmed, compiled to sharded Aho-Corasick automata, and located in all documents.

A window is ``WINDOW`` consecutive words of one document; each word covered by a window that also starts anywhere else is removed.

1. Documents with the same word sequence are one class, worked on once.  If a class has two rows or more, all its windows recur.
2. Seeds: the phrases of ``SEED`` words with the least hash of some window (minimizers).  Equal windows hold equal seeds, so
   a window can only recur if its least seed does.  Counting seeds (a tenth of the words) prunes all other text.
3. Confirm: a recurring seed belongs to the shard of the smallest class that has it and of the stretch of ``STRETCH`` words where that class has it, so copies of one
   stretch meet in one shard and a long text is spread over many.  The words around the seeds of a shard (their 64-bit hashes) are a fragment of the document, cut into
   pieces of at most ``STRETCH`` window starts; a document is never copied whole.  The windows of pieces are counted, folded in each task first; those met twice are
   the recurring passages.
4. Compile and locate: a shard's passages, 35 symbols each, are compiled to Aho-Corasick automata of at most ``PATTERNS`` passages, and every fragment of the
   shard is streamed through them.  The automaton's hits, each checked by its 64-bit hash, are the starts of recurring windows, and nothing else is.

A shard with many pieces is split into salts by bytes, pieces of one document too, each salt with its own copy of the confirmed hashes; a task's automata and text are thus
bounded, and the work is linear in the words around recurring seeds.  No step gathers the documents of a passage in one task, and no group is paired with itself.  Classes with many copies are joined by broadcasting them (there are few, see ``join_classes``).

Defined results: null text has no words (0, 0, hash of ''); repeated rows and repeated or null ids count as the rows they are; ties of hashes are equal
windows; a text of any length is one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .common import join_classes, table, tune

WINDOW, SEED = 35, 12
_PER = WINDOW - SEED + 1
#: Passages in one automaton (35 nodes each, about 60 MB).
PATTERNS = 20_000
#: Words of the owning class whose seeds share a shard, and most window starts of a piece; neighbours overlap by a window.
STRETCH = 8_192
_GAP = 0xFFFF
_EMPTY = hashlib.sha256(b"").hexdigest()
_TOP = tk.U(0xFFFFFFFFFFFFFFFF)


def _joined(w: tk.Words, keep: np.ndarray | None = None) -> list[str]:
    """Per document, SHA-256 of its (kept) words joined by one space."""
    size = len(w.data)
    cover = np.zeros(size + 1, np.int8)
    start, end = (w.start, w.end) if keep is None else (w.start[keep], w.end[keep])
    first = w.first if keep is None else np.concatenate([[0], np.cumsum(keep)])[w.first]
    cover[start] = 1
    cover[end] -= 1  # a word never starts where another ends: a separator or a document's end is between
    inside = np.cumsum(cover[:-1], dtype=np.int8).astype(bool)
    # word ends become the joining space: shift the kept bytes and put a space behind each word
    length = end - start
    to = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(int(to[-1]), 32, np.uint8)
    place = np.ones(int(to[-1]), bool)
    place[to[1:] - 1] = False
    out[place] = w.data[inside]
    raw = out.tobytes()
    return [hashlib.sha256(raw[to[a] : max(to[b] - 1, to[a])]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in tk.slices(batch):
            w = tk.words(b.column("text"))
            at, h = tk.minimizers(w, SEED, WINDOW)
            cut = np.searchsorted(at, w.first)
            local = at - np.repeat(w.first[:-1], np.diff(cut))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(np.diff(w.first)), pa.array(_joined(w)), _lists(h.view(np.int64), cut, pa.int64()), _lists(local.astype(np.int32), cut, pa.int32())], names=["doc_id", "th", "n_words", "sha", "seed", "at"])


def _fragments(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    """For each document and shard, the word hashes of all windows that hold a recurring seed of the shard, in merged ranges cut into pieces."""
    for batch in batches:
        for b in tk.slices(batch):
            w = tk.words(b.column("text"))
            seeds = b.column("seeds")
            flat = seeds.flatten()
            doc = np.repeat(np.arange(w.n), np.diff(seeds.offsets.to_numpy()))
            at, shard = w.first[doc] + flat.field("at").to_numpy(zero_copy_only=False), flat.field("shard").to_numpy(zero_copy_only=False)
            order = np.lexsort((at, shard, doc))
            at, shard, doc = at[order], shard[order], doc[order]
            lo, hi = np.maximum(at - (_PER - 1), w.first[doc]), np.minimum(at + WINDOW, w.first[doc + 1])
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1]) | (lo[1:] > hi[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
            # pieces: window starts [left, left + stretch) of the fragment, with the words of their windows
            pieces = np.maximum(1, -(-(hi[end] - lo[begin] - WINDOW + 1) // stretch))
            of = np.repeat(np.arange(len(begin)), pieces)
            left = lo[begin][of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stretch
            right = np.minimum(left + stretch + WINDOW - 1, hi[end][of])
            words = [w.h[x:y].tobytes() for x, y in zip(left.tolist(), right.tolist())]
            # seeds ascend inside a fragment; those of a piece are a range of them, and a seed near a cut is in both pieces
            base = np.cumsum(hi[end] - lo[begin] + 1) - (hi[end] - lo[begin] + 1)  # fragments laid behind each other, so one search serves all
            flow = at - np.repeat(lo[begin] - base, np.diff(np.append(begin, len(at))))
            a = np.searchsorted(flow, left - lo[begin][of] + base[of])
            z = np.searchsorted(flow, right - SEED - lo[begin][of] + base[of], "right")
            take = np.repeat(a - (np.cumsum(z - a) - (z - a)), z - a) + np.arange(int((z - a).sum()))
            inside = at[take] - np.repeat(left, z - a)
            source = pa.array(doc[begin][of])
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(source), b.column("copies").take(source), pa.array(shard[begin][of].astype(np.int32)), pa.array((left - w.first[doc[begin][of]]).astype(np.int32)), pa.array(words, pa.binary()), _lists(inside.astype(np.int32), np.concatenate([[0], np.cumsum(z - a)]), pa.int32())],
                names=["row", "copies", "shard", "at", "words", "seeds"],
            )


def _flat(words: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all word hashes, first of each fragment and behind the last)."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in words]
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, parts)])


def _inside(first: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n window starts lies in one fragment."""
    return np.arange(n) + WINDOW <= np.repeat(first[1:], np.diff(first))[:n]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, window hash, times) of the windows whose least seed recurs, added up in the batch."""
    for b in batches:
        h, first = _flat(b.column("words"))
        n = len(h) - WINDOW + 1
        if n <= 0:
            continue
        g = tk.rolling(h, SEED)
        seeds = b.column("seeds")
        at = np.repeat(first[:-1], np.diff(seeds.offsets.to_numpy())) + seeds.flatten().to_numpy(zero_copy_only=False)
        seen = np.full(len(g), _TOP)
        seen[at] = g[at]
        s = np.flatnonzero(_inside(first, n) & (tk.sliding(seen, _PER) == tk.sliding(g, _PER)))
        shard = b.column("shard").to_numpy()[np.searchsorted(first, s, "right") - 1]
        pair = np.empty(len(s), [("shard", np.int32), ("window", np.uint64)])
        pair["shard"], pair["window"] = shard, tk.rolling(h, WINDOW)[s]
        pair, times = np.unique(pair, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair["shard"]), pa.array(pair["window"].view(np.int64)), pa.array(times)], names=["shard", "window", "times"])


def _symbols(h: np.ndarray, first: np.ndarray) -> str:
    """One code point a word, from its hash, and a gap behind each fragment; hits are checked by full hashes."""
    return np.insert((h & tk.U(0xFFFFF)) + tk.U(0x10000), first[1:], tk.U(_GAP)).astype("<u4").tobytes().decode("utf-32-le")


def _locate(fragments: pa.Table, confirmed: pa.Table) -> pa.Table:
    """Compile a shard's confirmed passages (for one salt, those of its fragments) and stream all its fragments through the automata."""
    rows, runs = [], []
    known = np.sort(confirmed.column("window").to_numpy().view(np.uint64))
    h, first = _flat(fragments.column("words"))
    n = len(h) - WINDOW + 1
    if n > 0 and len(known):
        wh = tk.rolling(h, WINDOW)
        place = np.minimum(np.searchsorted(known, wh), len(known) - 1)
        passages = np.flatnonzero((known[place] == wh) & _inside(first, n))
        passages = passages[np.unique(wh[passages], return_index=True)[1]]  # where each passage is met first
        text = _symbols(h, first)
        shift = np.searchsorted(first, np.arange(len(h)), "right") - 1  # gaps before each word
        starts = []
        for cut in range(0, len(passages), PATTERNS):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for p in (passages[cut : cut + PATTERNS]).tolist():
                x = p + int(shift[p])
                automaton.add_word(text[x : x + WINDOW], p)
            automaton.make_automaton()
            hits = np.fromiter((x for hit in automaton.iter(text) for x in hit), np.int64).reshape(-1, 2)
            start = hits[:, 0] - (WINDOW - 1)
            start = start - (np.searchsorted(first[1:] + np.arange(1, len(first)), start, "right"))  # from symbols back to words
            starts.append(start[wh[start] == wh[hits[:, 1]]])
        found = np.sort(np.concatenate(starts or [np.zeros(0, np.int64)]))
        of = np.searchsorted(first, found, "right") - 1
        local = found - first[of] + fragments.column("at").to_numpy()[of]
        cut = np.searchsorted(of, np.arange(fragments.num_rows + 1))
        names = fragments.column("row").to_pylist()
        for i in np.flatnonzero(np.diff(cut)).tolist():
            rows.append(names[i])
            runs.append(_runs(local[cut[i] : cut[i + 1]].astype(np.int32)))
    return pa.table([pa.array(rows, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["row", "runs"])


def _runs(s: np.ndarray) -> list[int]:
    """Sorted window starts as alternating first and behind-last covered word."""
    gap = np.flatnonzero(np.diff(s) > WINDOW)
    first, last = s[np.concatenate([[0], gap + 1])], s[np.concatenate([gap, [len(s) - 1]])] + WINDOW
    return np.stack([first, last], axis=1).ravel().tolist()


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in tk.slices(batch):
            w = tk.words(b.column("text"))
            runs = b.column("runs")
            flat = runs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            base = np.repeat(w.first[:-1], np.diff(runs.offsets.to_numpy()))
            cover = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(cover, flat[0::2] + base[0::2], 1)
            np.add.at(cover, flat[1::2] + base[1::2], -1)
            gone = np.cumsum(cover)[:-1] > 0
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(w.sums(gone)), pa.array(_joined(w, ~gone))], names=["row", "gone", "kept"])


def substring_dedup(docs: DataFrame, shard_bytes: int = 2 << 20, salt_bytes: int = 4 << 20, stretch: int = STRETCH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for docs(doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    shards = max(1, -(-(rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0) // shard_bytes))
    base = table(rows.mapInArrow(_sketch, "doc_id long, th long, n_words long, sha string, seed array<long>, at array<int>"), "sub-seeds")
    # one number a word sequence: its class, which stands for it from here on
    classes = base.where(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "th")).alias("rep"))
    classes = table(classes.select("sha", "copies", "rep.doc_id", "rep.th").withColumn("row", F.monotonically_increasing_id()), "sub-classes")
    rep = classes.select("row", F.col("sha").alias("s"), F.col("doc_id").alias("i"), F.col("th").alias("t"))
    mine = (F.col("sha") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))
    one = base.join(rep, mine).groupBy("row").agg(F.first(F.arrays_zip("seed", "at")).alias("seeds"))
    each = table(one.select("row", F.explode("seeds").alias("s")).select("row", F.col("s.seed").alias("seed"), F.col("s.at").alias("at")), "sub-each")
    owner = F.min(F.struct(F.xxhash64("row").alias("h"), F.floor(F.col("at") / stretch).alias("stretch")))
    again = each.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), owner.alias("o")).where("n > 1")
    again = again.select("seed", F.pmod(F.xxhash64("o.h", "o.stretch"), F.lit(shards)).cast("int").alias("shard"))
    found = each.join(table(again, "sub-again"), "seed").groupBy("row").agg(F.collect_list(F.struct("at", "shard")).alias("seeds")).join(classes, "row")
    # ids may repeat: the text taken for a class is checked by its hash
    texts = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["th"] == found["th"])).select("row", "copies", "sha", "text", "seeds")
    texts = table(texts.mapInArrow(_same, "row long, copies long, text string, seeds array<struct<at:int,shard:int>>"), "sub-texts")
    fragments = table(texts.mapInArrow(lambda batches: _fragments(batches, stretch), "row long, copies long, shard int, at int, words binary, seeds array<int>"), "sub-fragments")
    confirmed = fragments.select("shard", "words", "seeds").mapInArrow(_windows, "shard int, window long, times long").groupBy("shard", "window").agg(F.sum("times").alias("times"))
    confirmed = table(confirmed.where("times > 1").drop("times"), "sub-windows")
    # documents of classes with copies go as a whole, so only the others are searched
    searched = fragments.where("copies = 1").select("shard", "row", "at", "words")
    # at most one row a shard, and the number of shards is known: broadcast only while that is small
    load = searched.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("words")) / F.lit(salt_bytes)).cast("int").alias("salts"))
    load = table(load.withColumn("salts", F.greatest("salts", F.lit(1))), "sub-load")
    load = F.broadcast(load) if shards <= 100_000 else load
    searched = searched.join(load, "shard").withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.col("salts")).cast("int"))
    confirmed = confirmed.join(load, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    hits = searched.select("shard", "salt", "row", "at", "words").groupBy("shard", "salt").cogroup(confirmed.select("shard", "salt", "window").groupBy("shard", "salt")).applyInArrow(_locate, "row long, runs array<int>")
    runs = hits.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    stripped = texts.where("copies = 1").select("row", "text").join(runs, "row").mapInArrow(_strip, "row long, gone long, kept string")
    of_class = table(classes.select("sha", "copies", "row").join(stripped, "row", "left").drop("row"), "sub-results")
    out = join_classes(base.select("doc_id", "n_words", "sha"), of_class, ["sha"], "copies", base.count())
    whole = F.col("copies") > 1
    return out.select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"), F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the word sequence of the class, without its hash."""
    for batch in batches:
        for b in tk.slices(batch):
            w = tk.words(b.column("text"), hashes=False)
            yield b.filter(pa.array([x == y for x, y in zip(_joined(w), b.column("sha").to_pylist())])).select(["row", "copies", "text", "seeds"])
