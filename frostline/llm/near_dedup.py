"""MinHash near-dedup with odd sketches.

Each document's shingle set gives ``BANDS * ROWS`` MinHash values.  Bands of ``ROWS`` values propose candidates; at Jaccard 0.8 a pair meets in
no band with probability (1 - 0.8**6)**32 = 6e-5.  The same values, folded into a parity bitmap (odd sketch), verify candidates: the
population count of the XOR of two bitmaps estimates how many values differ, so the high similarities near the threshold are
told apart precisely.  Only pairs more than five standard deviations below the threshold are dropped there; the others are
confirmed on the full sets.

Candidates without pairing groups with themselves: equal sets are one class, the node of all that follows.  In every bucket the first class is compared
with the members, and confirmed links are contracted to components; a bucket with one component is finished, as a large group of copies mostly is.
In the others only members outside the largest component are queries against the members: pair by pair in small buckets, and in large ones
in blocks of bounded size, where a task compares odd sketches first, intersects the full sets of what is left, and returns one link for each component
met.  So each pair of a bucket is compared or already connected, and no pair is a row but those of small buckets, pivots, and links.

Defined results: null, empty or word-less text has n_shingles 0 and component_id doc_id; a null id links with nothing (component null, kept);
each row is a document of its own, so rows that repeat an id with different texts link by their own texts, and rows that repeat both are one class.
A text of any length is one set; a slice of a batch holds at least one whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .common import join_classes, table, tune
from .components import contract

BANDS, ROWS = 32, 6
SKETCH_WORDS = 8
ODD = [f"o{i}" for i in range(SKETCH_WORDS)]
#: Buckets up to this size are compared pair by pair, larger ones in blocks.
SMALL_BUCKET = 32
#: Shingles of the documents in one block of a large bucket.
BLOCK_SHINGLES = 1_000_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | tk.U(1)
_B = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(w: tk.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first entry of each document, distinct shingle hashes): sorted inside a document."""
    at, h = tk.windows(w, k)
    doc = w.doc[at]
    n = np.diff(w.first)
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            h = np.concatenate([h, tk.rolling(w.h, m)[w.first[short]]])
            doc = np.concatenate([doc, short])
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.searchsorted(doc[new], np.arange(w.n + 1)), h[new]


def minhashes(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """documents x values; rows of documents without shingles are 0."""
    filled = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, BANDS * ROWS), np.uint64)
    if len(filled):
        for i in range(BANDS * ROWS):
            out[filled, i] = np.minimum.reduceat((h ^ _B[i]) * _A[i], first[filled])
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """documents x SKETCH_WORDS words of 64 parity bits."""
    bits = 64 * SKETCH_WORDS
    place = (tk.mix(values + np.arange(values.shape[1], dtype=np.uint64) * tk.U(0x9E3779B97F4A7C15)) % tk.U(bits)).astype(np.int64)
    flips = np.zeros((len(values), bits), np.uint8)
    np.add.at(flips, (np.arange(len(values))[:, None], place), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view(np.uint64)


def most_differing(threshold: float, sigmas: float = 5.0) -> int:
    """Largest XOR population count that is kept: from the odd-sketch expectation at ``sigmas`` below the threshold."""
    k, n = BANDS * ROWS, 64 * SKETCH_WORDS
    j = threshold - sigmas * (threshold * (1 - threshold) / k) ** 0.5
    return int(np.ceil(n / 2 * (1 - np.exp(-4 * k * (1 - j) / n)) + 3 * (n / 4) ** 0.5 * np.exp(-2 * k * (1 - j) / n)))


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in tk.slices(batch):
            w = tk.words(b.column("text"), lower=True)
            first, h = shingle_sets(w, k)
            n = np.diff(first)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(h + tk.U(s)))]) for s in (1, 2)]
            key = [s[first[1:]] - s[first[:-1]] for s in sums]
            values = minhashes(first, h)
            bands = _bands(values)
            flat = pa.array(np.ascontiguousarray(bands).view(np.int64).ravel())
            offsets = pa.array(np.arange(w.n + 1, dtype=np.int32) * BANDS)
            odd = odd_sketch(values).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in key), pa.ListArray.from_arrays(offsets, flat), *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(SKETCH_WORDS))], names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "bands", *ODD])


def _bands(values: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(values), 1))
    for r in range(ROWS):
        out = tk.mix(out * tk.U(0xC2B2AE3D27D4EB4F) + values[:, r::ROWS])
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in tk.slices(batch):
            w = tk.words(b.column("text"), lower=True)
            first, h = shingle_sets(w, k)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([h[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())], names=["node", "shingles"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("sa"), b.column("sb")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = _common(x, y)
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _search(t: pa.Table, percent: int, limit: int) -> pa.Table:
    """Links of the queries of a block to its base rows, exact, one for each component met."""
    t = t.combine_chunks()
    node, root, query, size = (t.column(c).to_numpy() for c in ("node", "root", "query", "size"))
    odd = np.stack([t.column(o).to_numpy().view(np.uint64) for o in ODD], axis=1)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
    base = np.flatnonzero(~query)
    base_root, base_size, base_odd = root[base], size[base], odd[base]
    a, b = [], []
    for i in np.flatnonzero(query).tolist():
        may = np.flatnonzero((base_root != root[i]) & (100 * np.minimum(base_size, size[i]) >= percent * np.maximum(base_size, size[i])))
        differing = np.bitwise_count(base_odd[may] ^ odd[i]).sum(axis=1)
        near = differing <= limit
        may = may[near][np.argsort(differing[near], kind="stable")]  # the likeliest link of a component first
        met = set()
        for j in may.tolist():
            if base_root[j] not in met:
                common = _common(sets[i], sets[base[j]])
                if 100 * common >= percent * (size[i] + base_size[j] - common):
                    met.add(base_root[j])
                    a.append(min(node[i], node[base[j]]))
                    b.append(max(node[i], node[base[j]]))
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_dedup(docs: DataFrame, shingle_words: int = 4, percent: int = 80, broadcast_ids: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for docs(doc_id, text); links at Jaccard >= percent / 100 of the shingle sets.

    Beside them: text_hash (xxhash64 of the text), ``component`` (null where nothing can link), and ``first``: whether the row has the least
    (doc_id, text_hash) of its component, so keeping one of the rows that are first keeps one document of each group.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    key = ["k1", "k2", "n_shingles"]
    base = table(rows.mapInArrow(lambda x: _sketches(x, shingle_words), f"doc_id long, text_hash long, n_shingles long, k1 long, k2 long, bands array<long>, {', '.join(f'{o} long' for o in ODD)}"), "mh-base")
    own = base.where("n_shingles > 0 and doc_id is not null")
    classes = own.groupBy(*key).agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("bands", *ODD)))
    classes = table(classes.withColumn("node", F.monotonically_increasing_id()), "mh-classes")
    member = classes.select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").alias("size"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1").drop("n")
    members = table(member.join(shared, "bucket"), "mh-members")
    need = members.select("node").distinct().join(classes.select("node", "rep"), "node").select("node", "rep.doc_id", "rep.text_hash")
    need = table(need, "mh-need")
    texts = rows.join(F.broadcast(need) if need.count() <= broadcast_ids else need, ["doc_id", "text_hash"])
    if own.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["node"])
    sets = table(texts.select("node", "text").mapInArrow(lambda x: _sets(x, shingle_words), "node long, shingles binary"), "mh-sets")
    limit = most_differing(percent / 100)

    def linked(pairs: DataFrame) -> DataFrame:
        """pairs(a, b) whose odd sketches are near and whose full sets reach the threshold."""
        left = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), *(F.col(o).alias(f"a{o}") for o in ODD))
        right = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), *(F.col(o).alias(f"b{o}") for o in ODD))
        differing = sum((F.bit_count(F.col(f"a{o}").bitwiseXOR(F.col(f"b{o}"))) for o in ODD), F.lit(0))
        sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        near = pairs.distinct().join(left, "a").join(right, "b").where(sizes & (differing <= limit)).select("a", "b")
        full = near.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        return table(full.select("a", "b", "sa", "sb").mapInArrow(lambda x: _confirm(x, percent), "a long, b long"), "mh-links")

    nothing = spark.createDataFrame([], "node long, root long")
    labels = contract(nothing, linked(members.where("pivot < node").select(F.col("pivot").alias("a"), F.col("node").alias("b"))))
    rooted = table(members.select("bucket", "node", "size").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), "mh-rooted")
    per = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    opened = per.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("total"), F.max_by("size", F.struct("n", "root")).alias("main"))
    opened = table(opened.where("kinds > 1").select("bucket", "largest", "n", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.ceil((F.col("total") - F.col("main")) / BLOCK_SHINGLES).cast("int").alias("chunks")), "mh-open")
    waiting = table(rooted.join(opened, "bucket"), "mh-waiting")
    few = waiting.where(F.col("n") <= SMALL_BUCKET).select("bucket", F.col("node").alias("a"), F.col("root").alias("ra"))
    pairs = few.join(few.select("bucket", F.col("a").alias("b"), F.col("ra").alias("rb")), "bucket").where("a < b and ra <> rb").select("a", "b")
    many = waiting.where(F.col("n") > SMALL_BUCKET)
    # each member is a base row of one block, once for every chunk of queries; a member outside the largest component is also a query for every block
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.col(c), F.lit(1)) - 1))
    at = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.greatest(F.col(c), F.lit(1))).cast("int")
    base_rows = many.select("bucket", at("blocks", 1).alias("block"), spread("chunks").alias("chunk"), "node", "root", "size", F.lit(False).alias("query"))
    query_rows = many.where("root <> largest").select("bucket", spread("blocks").alias("block"), at("chunks", 2).alias("chunk"), "node", "root", "size", F.lit(True).alias("query"))
    tasks = base_rows.unionByName(query_rows).join(sets.join(classes.select("node", *ODD), "node"), "node")
    found = tasks.groupBy("bucket", "block", "chunk").applyInArrow(lambda t: _search(t, percent, limit), "a long, b long")
    labels = contract(labels, linked(pairs).union(table(found.distinct(), "mh-found")))

    roots = labels.select("root").distinct().select(F.col("root").alias("node"), "root")
    linked_nodes = table(labels.union(roots), "mh-nodes")
    first = linked_nodes.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("nodes"))
    named = join_classes(linked_nodes, table(first, "mh-first"), ["root"], "nodes", linked_nodes.count()).select("node", "root", "lead")
    of_class = classes.select(*key, "node", "copies", "rep").join(named, "node", "left")
    of_class = table(of_class.select(*key, "copies", F.coalesce("root", "node").alias("component"), F.coalesce("lead", "rep").alias("lead")), "mh-components")
    out = join_classes(own.select("doc_id", "text_hash", *key), of_class, key, "copies", own.count())
    same = (F.col("doc_id") == F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))
    out = out.select("doc_id", "n_shingles", F.col("lead.doc_id").alias("component_id"), (F.col("doc_id") == F.col("lead.doc_id")).alias("kept"), "text_hash", "component", same.alias("first"))
    alone = base.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_hash", F.lit(None).cast("long").alias("component"), F.lit(True).alias("first"))
    return out.unionByName(alone)
