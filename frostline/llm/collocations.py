"""Phrase collocation mining with depth-limited count tries.

A task counts the phrases of its texts, shard after shard of ``trie_words``, in a trie of limited depth: a node is a phrase, its depth the number of words, its parent the
phrase without the last word, its suffix link the phrase without the first.  The trie deepens by one level in each pass over the texts, and only below
nodes that can matter: a phrase of ``least`` occurrences has parts of as many, so a node is grown where its parent and its suffix are frequent in the whole
corpus.  Tasks know that from a bit array of fixed size (``filter_bits``) over the frequent nodes of the level above; what it lets through wrongly is counted and dropped.

A shard's new level is serialised sorted, by the 64-bit hashes of its words.  The sorted runs of all shards are merged by ranges of that order, which
Spark cuts from a sample, so a frequent first word or prefix is spread over ranges; equal nodes are neighbours in one range and are summed as it streams by.

The frequent nodes of all levels, in depth-first order, are the pruned trie.  A walk along a sorted range has the left parts of a phrase on its path, as they are its
ancestors; only ancestors of a range's first nodes can lie in earlier ranges, at most ``max_words`` - 1 a range, and these are joined afterwards.
Right parts follow the suffix links, one join of the pruned nodes for each depth: the suffix's own count and its own right parts.  A phrase lies in a longer
one exactly if it lies in one that is a word longer and as frequent at least, so a node's children and those whose suffix it is decide what is dropped.

Scores are exact integer quotients of up to 38 digits.  The best of a language are ranked in salted parts first, so no task gets all its candidates.
Words are told apart by 64-bit hashes within a language; two words with one hash would be found in the table of words and raise an error.

Defined results: null text is empty; null lang is ``und``; repeated rows count each; a phrase does not cross ``.,;:!?`` or a line end; an empty table gives no
rows; texts of any length are counted whole; equal scores go by the larger count, then by the phrase's bytes; only lang and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import textkernel as tk
from .common import documents, table, tune

#: Words counted in one trie, or those of one longer slice of text.
TRIE_WORDS = 1_500_000
#: Bits that tell tasks which nodes are frequent: 16 MB, whatever the corpus.
FILTER_BITS = 1 << 27
SALTS = 32
#: Totals of so many languages are broadcast; those of more are joined by shuffling.
BROADCAST_LANGS = 100_000
#: Stands for no word; it sorts before all, so a parent goes before its children.
NONE = -(1 << 63)
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True


def pieces(texts: pa.Array) -> tuple[tk.Words, np.ndarray]:
    """(words in lower case, whether a word begins a piece)."""
    data, off = tk.buffers(texts)
    mark = _PIECE[data]
    clean = np.ascontiguousarray(np.where(mark, np.uint8(0x20), data))
    w = tk.words(pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(clean)]), lower=True)
    cuts = np.concatenate([[0], np.cumsum(mark)])[w.start]
    fresh = np.ones(len(w.h), bool)
    fresh[1:] = cuts[1:] != cuts[:-1]
    fresh[w.first[:-1][np.diff(w.first) > 0]] = True
    return w, fresh


def node_hash(path: list[np.ndarray], lang: str) -> np.ndarray:
    """A hash of each node, for the bit array; path has the words' hashes, level by level."""
    h = np.full(len(path[0]), np.frombuffer((lang.encode() + bytes(8))[:8], np.uint64)[0] + tk.U(len(lang)))
    for x in path:
        h = tk.mix((h ^ x.view(np.uint64)) * tk.U(0xC2B2AE3D27D4EB4F) + tk.U(1))
    return h


def bit_at(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & tk.U(64 * len(bits) - 1)
    return (bits[(at >> tk.U(6)).astype(np.int64)] >> (at & tk.U(63))) & tk.U(1) == 1


def grown(h: np.ndarray, fresh: np.ndarray, lang: str, bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(places where a node of the newest level begins, its number in sorted order, the distinct nodes' paths); ``bits`` of the levels above."""
    distinct, word = np.unique(h, return_inverse=True)
    at, number, path = np.arange(len(h)), word, [distinct]
    here = np.cumsum(fresh)
    for level, frequent in enumerate(bits, 1):
        passes = np.zeros(len(h) + 1, bool)
        passes[at] = bit_at(frequent, node_hash(path, lang))[number]
        numbers = np.zeros(len(h), np.int64)
        numbers[at] = number
        # parent and suffix, one level up, must both be frequent
        at = at[at + level < len(h)]
        at = at[passes[at] & passes[at + 1] & (here[at] == here[at + level])]
        # numbers follow the sorted order, so parent number and last word sort as the whole path does
        found, number = np.unique((numbers[at] << 32) | word[at + level], return_inverse=True)
        path = [*(x[found >> 32] for x in path), distinct[found & 0xFFFFFFFF]]
    return at, number, path


def _count(held: dict[str, list[tuple]], bits: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The newest level of a shard's tries, one sorted run a language; of single words also their bytes."""
    for lang, parts in held.items():
        h, fresh = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        _, number, path = grown(h, fresh, lang, bits)
        f = np.bincount(number, minlength=len(path[0]))
        columns = [pa.array([lang] * len(f), pa.string()), *map(pa.array, path), pa.array(f.astype(np.int64))]
        if not bits:
            _, some = np.unique(np.concatenate([x[2] for x in parts]), return_index=True)
            columns.append(pa.concat_arrays([x[3] for x in parts]).take(pa.array(some)))
        run = pa.RecordBatch.from_arrays(columns, names=names)
        yield from (run.slice(i, 100_000) for i in range(0, len(f), 100_000))


def _shards(batches: Iterator[pa.RecordBatch], bits: list[np.ndarray], names: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    """Texts are hashed slice by slice, so a shard holds its words' hashes and not its texts."""
    held, size = {}, 0
    for batch in batches:
        for b in tk.slices(batch):
            for lang in b.column("lang").unique().to_pylist():
                w, fresh = pieces(b.column("text").filter(pa.compute.equal(b.column("lang"), lang)))
                h = w.h.view(np.int64)
                if not len(h):
                    continue
                if size and size + len(h) > limit:
                    yield from _count(held, bits, names)
                    held, size = {}, 0
                part = [h, fresh]
                if not bits:
                    distinct, at = np.unique(h, return_index=True)
                    part += [distinct, pa.array([bytes(w.data[i:j]) for i, j in zip(w.start[at], w.end[at])], pa.binary())]
                held.setdefault(lang, []).append(tuple(part))
                size += len(h)
    if held:
        yield from _count(held, bits, names)


def _changes(lang: pa.Array, path: list[np.ndarray]) -> np.ndarray:
    """Whether a sorted row differs from the one before; the first does."""
    code = lang.dictionary_encode().indices.to_numpy()
    out = np.ones(len(code), bool)
    out[1:] = code[1:] != code[:-1]
    for x in path:
        out[1:] |= x[1:] != x[:-1]
    return out


def _merge(batches: Iterator[pa.RecordBatch], words: list[str], least: int) -> Iterator[pa.RecordBatch]:
    """Sums neighbours of a sorted range that are one node and drops rare ones; the last node of a batch waits for the next."""
    waiting: pa.RecordBatch | None = None

    def summed(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        at = np.flatnonzero(_changes(rows.column("lang").combine_chunks(), [rows.column(c).to_numpy() for c in words]))
        f = np.add.reduceat(rows.column("f").to_numpy(), at)
        out = rows.take(pa.array(at))
        return out.set_column(out.schema.get_field_index("f"), "f", pa.array(f)).combine_chunks().to_batches()[0]

    for b in batches:
        if b.num_rows:
            out = summed(pa.Table.from_batches([b] if waiting is None else [waiting, b]))
            waiting = out.slice(out.num_rows - 1)
            out = out.slice(0, out.num_rows - 1)
            yield out.filter(pa.compute.greater_equal(out.column("f"), least))
    if waiting is not None:
        yield waiting.filter(pa.compute.greater_equal(waiting.column("f"), least))


def _mark(batches: Iterator[pa.RecordBatch], words: list[str], bits: int) -> Iterator[pa.RecordBatch]:
    """The task's part of the bit array: words that are not 0."""
    held = np.zeros(bits // 64, np.uint64)
    for b in batches:
        lang = b.column("lang").dictionary_encode()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            mine = lang.indices.to_numpy() == code
            at = node_hash([b.column(c).to_numpy()[mine] for c in words], name) & tk.U(bits - 1)
            np.bitwise_or.at(held, (at >> tk.U(6)).astype(np.int64), tk.U(1) << (at & tk.U(63)))
    slot = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(held[slot].view(np.int64))], names=["slot", "bits"])


def frequent_bits(nodes: DataFrame, words: list[str], bits: int = FILTER_BITS) -> np.ndarray:
    """The bit array of nodes(lang, words); its size is fixed, so it may go through the driver."""
    got = nodes.select("lang", *words).mapInArrow(lambda x: _mark(x, words, bits), "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _walk(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    """Along a sorted range of the trie: left1, left2, ... are the counts of the ancestors, null where an earlier range has them."""
    stack: list[tuple | None] = [None] * (len(words) - 1)  # the last node of each depth: (language, its words, count)
    for b in batches:
        if not b.num_rows:
            continue
        lang, depth, f = b.column("lang"), b.column("depth").to_numpy(), b.column("f").to_numpy()
        path = [b.column(c).to_numpy() for c in words]
        lefts = []
        for d in range(1, len(words)):
            own = depth == d
            begins = _changes(lang, path[:d])
            group = np.cumsum(begins)
            # a node of this depth stands first among the rows that share its words
            holder = np.flatnonzero(begins)
            has, count = own[holder], f[holder].astype(np.int64)
            before = stack[d - 1]
            if before is not None and not has[0] and before[0] == lang[0].as_py() and before[1] == tuple(int(x[0]) for x in path[:d]):
                has[0], count[0] = True, before[2]
            lefts.append(pa.array(count[group - 1], mask=~(has[group - 1] & (depth > d))))
            last = holder[-1]
            stack[d - 1] = (lang[int(last)].as_py(), tuple(int(x[last]) for x in path[:d]), int(count[-1])) if has[-1] else None
        yield pa.RecordBatch.from_arrays([*b.columns, *lefts], names=[*b.schema.names, *(f"left{d}" for d in range(1, len(words)))])


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, trie_words: int = TRIE_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs(lang, text): the ``top`` phrases of 2 to ``max_words`` words of each language."""
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    w = [f"w{d}" for d in range(1, max_words + 1)]
    longs = lambda names: ", ".join(f"{c} long" for c in names)

    counted = texts.mapInArrow(lambda x: _shards(x, [], ["lang", "w1", "f", "word"], trie_words), "lang string, w1 long, f long, word binary")
    words = table(counted.groupBy("lang", "w1", "word").agg(F.sum("f").alias("f")), "co-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    if frequent.groupBy("lang", "w1").count().where("count > 1").limit(1).count():
        raise ValueError("two words of a language have one hash")
    levels, bits = [frequent.select("lang", "w1", "f")], []
    for depth in range(2, max_words + 1):
        bits.append(frequent_bits(levels[-1], w[: depth - 1], filter_bits))
        sent, path = spark.sparkContext.broadcast(bits), w[:depth]
        runs = texts.mapInArrow(lambda x, sent=sent, path=path: _shards(x, sent.value, ["lang", *path, "f"], trie_words), f"lang string, {longs(path)}, f long")
        runs = table(runs, f"co-runs-{depth}")
        ranged = runs.repartitionByRange("lang", *path).sortWithinPartitions("lang", *path)
        levels.append(table(ranged.mapInArrow(lambda x, path=path: _merge(x, path, least), f"lang string, {longs(path)}, f long"), f"co-level-{depth}"))
        sent.unpersist()

    whole = [x.select("lang", *(F.col(c) if c in x.columns else F.lit(NONE).alias(c) for c in w), F.lit(d).alias("depth"), "f") for d, x in enumerate(levels, 1)]
    trie = whole[0]
    for x in whole[1:]:
        trie = trie.unionByName(x)
    trie = table(trie, "co-trie")
    lefts = [f"left{d}" for d in range(1, max_words)]
    walked = trie.repartitionByRange("lang", *w).sortWithinPartitions("lang", *w)
    walked = table(walked.mapInArrow(lambda x: _walk(x, w), f"lang string, {longs(w)}, depth int, f long, {longs(lefts)}"), "co-walked")
    for d, name in enumerate(lefts, 1):
        # ancestors in an earlier range: one of each depth for a range at most, so their table is as small as the number of ranges
        gap = (F.col("depth") > d) & F.col(name).isNull()
        heads = walked.where(gap).select("lang", *w[:d]).distinct()
        held = F.broadcast(heads.join(trie.where(F.col("depth") == d).select("lang", *w[:d], F.col("f").alias("found")), ["lang", *w[:d]]))
        filled = walked.where(gap).join(held, ["lang", *w[:d]]).withColumn(name, F.col("found")).select(*walked.columns)
        walked = walked.where(~gap).unionByName(filled)
    walked = table(walked, "co-nodes")

    # right parts by suffix links: right1 is the count of the last word, right2 of the last two
    linked = walked.where("depth = 1")
    every = None
    for d in range(2, max_words + 1):
        target = linked.select("lang", *(F.col(c).alias(to) for c, to in zip(w, w[1:d])), *(F.col(f"right{k}") for k in range(1, d - 1)), F.col("f").alias(f"right{d - 1}"))
        linked = table(walked.where(F.col("depth") == d).join(target, ["lang", *w[1:d]]), f"co-linked-{d}")
        every = linked if every is None else every.unionByName(linked, allowMissingColumns=True)

    # a node lies in each of its children and in the nodes whose suffix link it is
    around = None
    for d in range(3, max_words + 1):
        longer = every.where(F.col("depth") == d)
        for part in (w[: d - 1], w[1:d]):
            one = longer.select("lang", *(F.col(c).alias(to) for c, to in zip(part, w)), *(F.lit(NONE).alias(c) for c in w[d - 1 :]), F.col("f").alias("longer"))
            around = one if around is None else around.unionByName(one)
    candidates = every
    if around is not None:
        around = around.groupBy("lang", *w).agg(F.max("longer").alias("longer"))
        candidates = every.join(around, ["lang", *w], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("f")))

    def cut(k: int, depth: int) -> str:
        """The phrase of this depth cut behind its first k words."""
        return f"struct((CAST(1000000 AS DECIMAL(7,0)) * (CAST(f AS DECIMAL(15,0)) * CAST(f AS DECIMAL(15,0)))) div (CAST(left{k} AS DECIMAL(18,0)) * CAST(right{depth - k} AS DECIMAL(18,0))) AS score, {k} AS k, left{k} AS l, right{depth - k} AS r)"

    worst = F.expr("CASE depth " + " ".join(f"WHEN {d} THEN array_min(array({', '.join(cut(k, d) for k in range(1, d))}))" for d in range(2, max_words + 1)) + " END")
    scored = table(candidates.select("lang", *w, "depth", F.col("f").alias("a"), worst.alias("cut")), "co-scored")
    for d in range(1, max_words + 1):
        of = frequent.select("lang", F.col("w1").alias(f"w{d}"), F.decode("word", "UTF-8").alias(f"word{d}"))
        scored = scored.join(of, ["lang", f"w{d}"], "inner" if d < 3 else "left")
    phrase = F.concat_ws(" ", *(f"word{d}" for d in range(1, max_words + 1)))
    named = scored.select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    few = totals.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    return best.join(F.broadcast(totals) if few else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the first 2000 phrases of every language."""
    return collocations(documents(spark, sf_dir))


SQL = r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, m, unnest(list_transform(range(1, CAST(len(w) - m + 2 AS BIGINT)), lambda i: w[i:i + m - 1])) AS w FROM p, (VALUES (1), (2), (3)) s(m)),
    f AS (SELECT lang, w, len(w) AS m, count(*) AS f FROM g GROUP BY lang, w),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT * FROM f WHERE m >= 2 AND f >= 10),
    o AS (
        SELECT lang, w, max(f) AS f FROM (SELECT lang, w[1:2] AS w, f FROM c WHERE m = 3 UNION ALL SELECT lang, w[2:3], f FROM c WHERE m = 3) GROUP BY lang, w),
    k AS (SELECT c.lang, c.w, c.m, c.f AS a, unnest(range(1, c.m)) AS k FROM c LEFT JOIN o ON o.lang = c.lang AND o.w = c.w WHERE o.f IS NULL OR 100 * o.f < 50 * c.f),
    x AS (
        SELECT k.lang, k.w, k.a, k.k, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * k.a * k.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
        FROM k JOIN f l ON l.lang = k.lang AND l.w = k.w[1:k.k] JOIN f r ON r.lang = k.lang AND r.w = k.w[k.k + 1:]),
    w AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM x GROUP BY lang, w, a),
    t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM w)
    SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000"""
