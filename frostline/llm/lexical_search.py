"""Ranked lexical search: postings grouped by exact impact, processed score at a time.

Terms are the maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A term of a document has an impact that depends on its occurrences and
the document's length only, so the postings of a term fall into groups of one exact impact.  ``build_index`` makes shards of at most about ``SHARD_POSTINGS``
postings of whole documents: a shard is one row that holds, by term and descending impact, the group's documents, and beside them the terms by document.
``search`` takes each shard alone: the groups of a query's terms are visited by descending weight * impact and added to the documents'
sums.  It stops only when the terms' next groups, summed, can no longer lift any further document to the k-th best sum so far; the few documents that
still can reach it get complete scores from the terms by document.  The best k of each shard, not more, are shuffled, and two window steps keep k of each query: the
first within salted parts, so that no task gets all shards' rows.

Shards need nothing of each other but the collection's figures (documents, terms, frequency of each query term), so the index is built and searched without a
shuffle of postings, and a lost task is one shard's work.  Queries go out in blocks of at most ``BLOCK_TERMS`` term entries, a bounded broadcast; each block is one pass over
the index.  Scores are 64-bit integers, so the order of additions does not matter.  Terms are compared by 64-bit hashes of their bytes.

Defined results: null and term-less documents are not ranked and do not count; null queries and those without terms have no rows; equal scores go by
ascending doc_id, null ids last; rows that repeat an id are documents of their own, and rows that repeat an item_id are queries of their own whose results stand beside
each other; fewer than k documents with a score above 0 are all returned; empty tables give no rows; texts of any length are read whole (a document
with more postings than a shard takes is a shard of its own); only doc_id, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import textkernel as tk
from .common import documents, table, tune

#: Postings of one shard; a shard is built and searched in memory.
SHARD_POSTINGS = 250_000
#: (query, term) entries sent to all tasks at once, 24 bytes each.
BLOCK_TERMS = 1_000_000
#: Parts in which the shards' results of a query are merged first.
SALTS = 32
#: Shards in one file of the index, as readers hold a file's rows together.
FILE_SHARDS = 2
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SHARD = "docs binary, nulls binary, terms binary, impacts binary, starts binary, places binary, first binary, own_terms binary, own_impacts binary"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first entry of each text, hash of each term in order of the text); separators are ASCII, so bytes do for characters."""
    data, off = tk.buffers(texts)
    inside = _TERM[tk._LOWER[data]]
    clean = np.where(inside, tk._LOWER[data], np.uint8(0x20))
    w = tk.words(pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(clean))]))
    return w.first, w.h


def frequencies(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each text, distinct terms sorted inside a text, occurrences)."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return np.searchsorted(doc[at], np.arange(len(first))), h[at], np.diff(np.append(at, len(h)))


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in tk.slices(batch):
            first, h = terms_of(b.column("text"))
            n = np.diff(first)
            own, term, tf = frequencies(first, h)
            kept = np.flatnonzero(n)
            cut = lambda x, kind: pa.array([x[own[i] : own[i + 1]].astype(kind).tobytes() for i in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(kept)), pa.array(n[kept].astype(np.int64)), cut(term, np.uint64), cut(tf, np.int64)], names=["doc_id", "n", "terms", "tf"])


def forward(docs: DataFrame) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term, as a table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return table(rows.mapInArrow(_forward, "doc_id long, n long, terms binary, tf binary"), "ls-forward")


def impact(tf: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """What one occurrence pattern is worth, before the term's weight."""
    m = 50 + 50 * n * documents // occurrences
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _shards(batches: Iterator[pa.RecordBatch], documents: int, occurrences: int, limit: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def shard() -> pa.RecordBatch:
        ids = [np.ma.array([r[0] or 0], mask=[r[0] is None]) for r in held]
        docs = np.ma.concatenate(ids)
        n = np.array([r[1] for r in held], np.int64)
        term = [np.frombuffer(r[2], np.uint64) for r in held]
        first = np.cumsum([0, *map(len, term)])
        term, tf = np.concatenate(term), np.concatenate([np.frombuffer(r[3], np.int64) for r in held])
        place = np.repeat(np.arange(len(held), dtype=np.int32), np.diff(first))
        worth = impact(tf, n[place], documents, occurrences)
        order = np.lexsort((place, -worth, term))
        t, w = term[order], worth[order]
        starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (w[1:] != w[:-1])]))
        columns = (t[starts], w[starts].astype(np.int32), np.append(starts, len(t)).astype(np.int32), place[order], first.astype(np.int32), term, worth.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (docs.filled(0).astype(np.int64), np.ma.getmaskarray(docs), *columns)], names=[c.split()[0] for c in _SHARD.split(", ")])

    for b in batches:
        for row in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("terms").to_pylist(), b.column("tf").to_pylist()):
            more = len(row[2]) // 8
            if held and size + more > limit:
                yield shard()
                held, size = [], 0
            held.append(row)
            size += more
    if held:
        yield shard()


def build_index(rows: DataFrame, documents: int, occurrences: int, limit: int = SHARD_POSTINGS) -> DataFrame:
    """Shards, one a row, of forward rows of a collection with so many documents and term occurrences; a table."""
    return table(rows.mapInArrow(lambda x: _shards(x, documents, occurrences, limit), _SHARD), "ls-index", maxRecordsPerFile=FILE_SHARDS)


class Shard:
    """A shard's postings: groups of one exact impact by term and descending impact, and terms by document."""

    def __init__(self, row: dict[str, bytes]):
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.docs, self.nulls, self.terms, self.impacts, self.starts = read("docs", np.int64), read("nulls", bool), read("terms", np.uint64), read("impacts", np.int32).astype(np.int64), read("starts", np.int32).astype(np.int64)
        self.places, self.first, self.own_terms, self.own_impacts = read("places", np.int32), read("first", np.int32), read("own_terms", np.uint64), read("own_impacts", np.int32)

    def complete(self, doc: int, terms: np.ndarray, weights: np.ndarray) -> int:
        """The whole score of a document from its own terms."""
        a, b = self.first[doc], self.first[doc + 1]
        own = self.own_terms[a:b]
        at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
        return int((weights * np.where(own[at] == terms, self.own_impacts[a:b][at], 0)).sum())

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best k above 0, ties at the end by id; terms are distinct and sorted."""
        low, high = np.searchsorted(self.terms, terms, "left"), np.searchsorted(self.terms, terms, "right")
        count = np.where(weights > 0, high - low, 0)
        if not count.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(terms)), count)
        group = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
        value = weights[of] * self.impacts[group]
        # behind each position, what the terms' next groups add at most together: a group's successor in its term takes its place
        following = np.where(np.append(of[1:] == of[:-1], False), np.append(value[1:], 0), 0)
        order = np.argsort(-value, kind="stable")  # by descending score; the groups of one term stay in their order
        remaining = value[np.cumsum(count)[count > 0] - count[count > 0]].sum() - np.cumsum((value - following)[order])
        group, value = group[order], value[order]
        size = self.starts[group + 1] - self.starts[group]
        done = np.cumsum(size)
        sums = np.zeros(len(self.docs), np.int64)
        p, step = 0, max(2 * k, 256)
        few = max(4 * k, 64)
        while p < len(group):
            # as many groups as fit in the step, so the stop is tried before a large group and not behind it
            end = max(p + 1, int(np.searchsorted(done, (done[p - 1] if p else 0) + step, "right")))
            spans, lengths = self.starts[group[p:end]], size[p:end]
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(spans, lengths)
            np.add.at(sums, self.places[at], np.repeat(value[p:end], lengths))
            p, step = end, 2 * step
            if p < len(group) and len(sums) > k:
                kth = np.partition(sums, len(sums) - k)[len(sums) - k]
                rest = remaining[p - 1]
                if kth > 0 and (may := np.flatnonzero(sums + rest >= kth)).size <= few:
                    score = np.array([self.complete(d, terms, weights) for d in may.tolist()], np.int64)
                    return self._best(may, score, k)
        met = np.flatnonzero(sums)
        return self._best(met, sums[met], k)

    def _best(self, docs: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        docs, score = docs[score > 0], score[score > 0]
        order = np.lexsort((self.docs[docs], self.nulls[docs], -score))[:k]
        return docs[order], score[order]


def _searched(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            shard = Shard(row)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for q, terms, weights in queries:
                docs, score = shard.search(terms, weights, k)
                for x, y in zip(out, (np.full(len(docs), q, np.int64), shard.docs[docs], shard.nulls[docs], score)):
                    x.append(y)
            q, doc, null, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(doc.astype(np.int64), mask=null.astype(bool)), pa.array(score.astype(np.int64))], names=["query", "doc_id", "score"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in tk.slices(batch):
            first, term, _ = frequencies(*terms_of(b.column("text")))
            query = np.repeat(b.column("query").to_numpy(), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(term.view(np.int64))], names=["query", "term"])


def _document_frequencies(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents that hold each wanted term, by task."""
    found = np.zeros(len(wanted), np.int64)
    for b in batches:
        for x in b.column("terms"):
            own = np.frombuffer(x.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            found[at[wanted[at] == own]] += 1
    held = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(wanted[held].view(np.int64)), pa.array(found[held])], names=["term", "df"])


def _in_blocks(asked: DataFrame, limit: int) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Queries with their terms and weights, in blocks of about ``limit`` entries (a query is whole in its block); a block is what the driver holds and sends."""
    parts = max(1, -(-asked.count() // limit))
    for part in range(parts):
        got = asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).toArrow()
        query, term, weight = (got.column(c).to_numpy() for c in ("query", "term", "weight"))
        term = term.view(np.uint64)
        order = np.lexsort((term, query))
        query, term, weight = query[order], term[order], weight[order]
        cut = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        yield [(int(query[i]), term[i:j], weight[i:j]) for i, j in zip(cut, np.append(cut[1:], len(query)))]


def search(docs: DataFrame, items: DataFrame, k: int = 50, shard_postings: int = SHARD_POSTINGS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs(doc_id, text) for each row of items(item_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    rows = forward(docs)
    documents, occurrences = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    queries = table(items.select("item_id", "text").where("text is not null").withColumn("query", F.monotonically_increasing_id()), "ls-queries")
    asked = table(queries.select("query", "text").mapInArrow(_query_terms, "query long, term long"), "ls-query-terms")
    nothing = spark.createDataFrame([], "query long, doc_id long, score long")
    found = nothing
    if documents:
        index = build_index(rows, documents, occurrences, shard_postings)
        counted = _counted(rows, asked, block_terms)
        weight = F.floor(1000 * F.log(F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
        # terms that no document holds add nothing
        weighted = table(asked.join(counted, "term").select("query", "term", weight.alias("weight")), "ls-weighted")
        for block in _in_blocks(weighted, block_terms):
            if block:
                sent = spark.sparkContext.broadcast(block)
                found = found.unionByName(table(index.mapInArrow(lambda x, sent=sent: _searched(x, sent.value, k), "query long, doc_id long, score long"), "ls-found"))
                sent.unpersist()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= k)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _counted(rows: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(term, df) of the queries' terms that documents hold, the terms sent in sorted blocks of at most about ``limit``."""
    terms = table(asked.select("term").distinct(), "ls-terms")
    parts = max(1, -(-terms.count() // limit))
    out = None
    for part in range(parts):
        wanted = np.sort(terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).toArrow().column("term").to_numpy().view(np.uint64))
        if len(wanted):
            sent = rows.sparkSession.sparkContext.broadcast(wanted)
            one = rows.select("terms").mapInArrow(lambda x, sent=sent: _document_frequencies(x, sent.value), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.sparkSession.createDataFrame([], "term long, df long")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the 50 best documents of every benchmark item."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
    WITH t AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
        FROM documents WHERE text IS NOT NULL),
    g AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS occurrences FROM t WHERE len(t) > 0),
    q AS (
        SELECT row_number() OVER () AS q, item_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
        FROM benchmark WHERE text IS NOT NULL),
    qt AS (SELECT DISTINCT q, item_id, unnest(t) AS term FROM q),
    u AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM t),
    p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM qt) GROUP BY r, doc_id, n, term),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
    s AS (
        SELECT qt.q, qt.item_id, p.r, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * g.docs) // g.occurrences)))) AS BIGINT) AS score
        FROM qt JOIN p USING (term) JOIN w USING (term), g GROUP BY qt.q, qt.item_id, p.r, p.doc_id),
    k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""
