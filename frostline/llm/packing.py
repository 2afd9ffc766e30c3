"""Variable-capacity best-fit packing.

Documents become pieces of at most the largest permitted length (a longer document is cut, nothing is dropped).  Pieces are dealt by a hash of
the id to shards of a bounded number of tokens, and each shard is packed on its own.  A sequence of a permitted length c costs, padding included,

    cost(c) = c + c * c / attention + overhead

in token equivalents: work linear in the tokens, attention's quadratic share (equal to the linear one at c = ``attention``, six times a model's width) and a
fixed part, so a long bin must earn its length by what it holds.  Pieces in decreasing order go to the open bin with the least room that fits.  If none
fits, a bin is opened at the capacity of least cost per token it can hope to fill:

    cost(c) / min(c, piece + tokens still to place that fit beside it)

That hope is too high where small pieces run short, so the shard is also packed with each permitted length as the least one to open, and once more
for each with every bin that can be emptied into the others dissolved.  The packing of least total cost, its bins downsized to the smallest permitted
capacity that holds them, is the one that counts: all lengths are chosen together, by what they cost the whole shard.

Shards depend on ids and total size alone, so a rerun after a lost executor packs alike.  A shard is the unit of memory: raise the number of shards,
never the size.  A piece row has its place, so bins can be written by grouping on (shard, bin).

Rows that repeat an id (or, with a null id, a text) would share a shard.  Ids with over half a shard's bytes are counted, and their rows are dealt over as many
shards as their bytes need, by their place in the input; all other rows by the hash alone.

Defined results: a text without words has one piece of its end token; null text counts as empty; a null id is dealt by its text; repeated rows are packed as the
rows they are; pieces of equal size keep the order of hash and length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import table, tune

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: The length at which attention costs as much as all else: six times the width, here of a model 4 096 wide.
ATTENTION = 24_576.0
#: With up to so many shards the heavy ids, two a shard at most, are broadcast.
BROADCAST_SHARDS = 100_000
_OUT = "doc_id long, piece int, first_token long, n_tokens int, shard int, bin int, offset int, capacity int, bin_tokens int"


def bin_cost(capacity: np.ndarray, overhead: float, attention: float) -> np.ndarray:
    """Cost of sequences of these lengths, in token equivalents."""
    c = np.asarray(capacity, np.float64)
    return c + c * c / attention + overhead


class _Rooms:
    """Open bins by the room they have left; the tightest that fits is found by one bit operation."""

    def __init__(self, largest: int):
        self.holders: list[list[int]] = [[] for _ in range(largest + 1)]
        self.bits = 0  # bit r: some bin has room r

    def add(self, b: int, room: int) -> None:
        if not self.holders[room]:
            self.bits |= 1 << room
        self.holders[room].append(b)

    def tightest(self, n: int) -> tuple[int, int] | None:
        fits = self.bits >> n
        if not fits:
            return None
        room = n + (fits & -fits).bit_length() - 1
        b = self.holders[room].pop()
        if not self.holders[room]:
            self.bits ^= 1 << room
        return b, room


def _place(sizes: list[int], opened: list[int], largest: int) -> tuple[list[int], int]:
    """Bin of each piece, and the number of bins, if the i-th piece opens a bin of ``opened[i]`` where no open bin fits."""
    rooms, where, bins = _Rooms(largest), [], 0
    for n, capacity in zip(sizes, opened):
        found = rooms.tightest(n)
        if found is None:
            found, bins = (bins, capacity), bins + 1
        where.append(found[0])
        rooms.add(found[0], found[1] - n)
    return where, bins


def _dissolved(sizes: np.ndarray, where: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """The placement with each bin whose pieces all fit into the room that others' downsized capacities leave dealt to them, emptiest first."""
    fill = np.bincount(where, sizes).astype(np.int64)
    room = (caps[np.searchsorted(caps, fill)] - fill).tolist()
    by_bin = np.split(np.argsort(where, kind="stable"), np.cumsum(np.bincount(where))[:-1])
    order = np.argsort(fill, kind="stable").tolist()
    rooms = _Rooms(int(caps[-1]))
    for b in reversed(order):
        rooms.add(b, room[b])
    out = where.copy()
    for b in order:
        rooms.holders[room[b]].remove(b)
        if not rooms.holders[room[b]]:
            rooms.bits ^= 1 << room[b]
        moved = []
        for i in by_bin[b].tolist():
            found = rooms.tightest(int(sizes[i]))
            if found is None:
                break
            moved.append((i, *found))
            room[found[0]] -= int(sizes[i])
            rooms.add(found[0], room[found[0]])
        if len(moved) == len(by_bin[b]):
            for i, to, _ in moved:
                out[i] = to
                by_bin[to] = np.append(by_bin[to], i)
            continue
        for i, to, before in reversed(moved):
            rooms.holders[room[to]].remove(to)
            if not rooms.holders[room[to]]:
                rooms.bits ^= 1 << room[to]
            room[to] = before
            rooms.add(to, before)
        rooms.add(b, room[b])
    return out


def best_fit(sizes: np.ndarray, capacities: Sequence[int], overhead: float, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the downsized capacity of each bin; pieces come in the order to place them, largest first."""
    caps = np.array(sorted(capacities), np.int64)
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    costs = bin_cost(caps, overhead, attention)
    sizes = np.asarray(sizes, np.int64)
    behind = np.cumsum(sizes[::-1])[::-1] - sizes  # tokens after each piece
    ordered = np.sort(sizes)
    below = np.concatenate([[0], np.cumsum(ordered)])
    need = np.searchsorted(caps, sizes)
    hoped = np.full((len(caps), len(sizes)), np.inf)
    for j, c in enumerate(caps.tolist()):
        beside = np.minimum(behind, below[np.searchsorted(ordered, c - sizes, "right")])
        hoped[j] = np.where(j >= need, costs[j] / np.minimum(c, sizes + beside), np.inf)
    policies = [len(caps) - 1 - hoped[::-1].argmin(axis=0), *(np.maximum(need, j) for j in range(len(caps)))]
    best = None
    for opened in policies:
        where = np.array(_place(sizes.tolist(), caps[opened].tolist(), int(caps[-1]))[0], np.int64)
        for placed in (where, _dissolved(sizes, where, caps)):
            fill = np.bincount(placed, sizes).astype(np.int64)
            total = costs[np.searchsorted(caps, fill[fill > 0])].sum()
            if best is None or total < best[0]:
                best = total, placed
    _, where = np.unique(best[1], return_inverse=True)
    fill = np.bincount(where, sizes).astype(np.int64)
    order = np.argsort(where, kind="stable")
    ahead = np.cumsum(sizes[order]) - sizes[order]
    starts = np.cumsum(fill) - fill
    offset = np.empty(len(sizes), np.int64)
    offset[order] = ahead - starts[where[order]]
    return where, offset, caps[np.searchsorted(caps, fill)]


def _pack(t: pa.Table, capacities: Sequence[int], overhead: float, attention: float) -> pa.Table:
    ids, tokens = t.column("doc_id").to_numpy(zero_copy_only=False), t.column("tokens").to_numpy()
    row = np.lexsort((tokens, t.column("tie").to_numpy()))
    largest = max(capacities)
    count = -(-tokens[row] // largest)
    doc = np.repeat(row, count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(tokens[doc] - piece * largest, largest)
    order = np.argsort(-size, kind="stable")
    where, offset, final = best_fit(size[order], capacities, overhead, attention)
    filled = np.bincount(where, size[order], len(final)).astype(np.int64)
    doc, piece, size = doc[order], piece[order], size[order]
    shard = t.column("shard")[0].as_py()
    at = pa.array(doc)
    cols = [t.column("doc_id").combine_chunks().take(at), piece.astype(np.int32), piece.astype(np.int64) * largest, size.astype(np.int32), np.full(len(doc), shard, np.int32), where.astype(np.int32), offset.astype(np.int32), final[where].astype(np.int32), filled[where].astype(np.int32)]
    return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in cols], names=[x.split()[0] for x in _OUT.split(", ")])


def word_tokens(text: str = "text") -> Column:
    """Whitespace words and an end token: the default length; pass another column for a tokenizer's counts."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def pack(docs: DataFrame, tokens: Column | None = None, capacities: Sequence[int] = CAPACITIES, overhead: float = 16, attention: float = ATTENTION, shard_tokens: int = 1 << 20) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, shard, bin, offset, capacity, bin_tokens for docs(doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    tie = F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.lit(1), tokens if tokens is not None else word_tokens()).cast("long").alias("tokens"), tie.alias("tie"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    # bytes / 2 + rows is never less than the number of word tokens, and needs no second tokenisation
    shards = max(1, -(-((total["b"] or 0) // 2 + total["n"]) // shard_tokens))
    load = F.coalesce(F.octet_length("text"), F.lit(0)) / 2 + 1
    heavy = docs.groupBy(tie.alias("tie")).agg(F.sum(load).alias("load")).where(F.col("load") > shard_tokens / 2)
    # at most two a shard, so their number is bounded by that of shards
    heavy = table(heavy.select("tie", F.ceil(F.col("load") / (shard_tokens / 2)).cast("long").alias("pieces")), "packing-heavy")
    deal = F.col("tie")
    if heavy.limit(1).count():
        rows = rows.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(heavy) if shards <= BROADCAST_SHARDS else heavy, "tie", "left")
        deal = F.when(F.col("pieces").isNotNull(), F.xxhash64("tie", F.pmod("place", "pieces"))).otherwise(deal)
    return rows.select("doc_id", "tokens", "tie", F.pmod(deal, F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInArrow(lambda t: _pack(t, capacities, overhead, attention), _OUT)
