"""URL filters: a blocked Bloom filter of listed canonical URLs lets possible hits through to an exact hash join.

A list entry is (host, path, verdict); it fits its host and all subdomains, where the path of the URL starts with its own.  The longest entry that fits
decides, and a URL that nothing fits gets the ``default``.

The canonical form of an entry is host + path.  A URL is looked up by keys of that form: every suffix of its host at a label's start, with every
prefix of its path that is as long as some path of the list (the distinct lengths, at most the longest URL's, are the only figures of the list that the driver
reads beside its size).  The filter is split into blocks of eight 64-bit words.  A key's hash chooses the block, and eight further hashes
one bit in each word, so a lookup reads one block.  Filter and lookup are column expressions.  It has ``bits_per_url`` bits for each
entry up to ``filter_bytes``; a longer list makes it denser, hence passes more, but results stay exact and what tasks are sent stays bounded.

Distinct (host, path) with a key that the filter passes are hash-joined with the list, whose side is broadcast only up to ``broadcast_rows``; that drops false
positives.  Their verdicts then join the pages, where a hot URL is one row on one side, so Spark can split the other.

Defined results: null URLs and those without ``://`` have empty host and path; an empty host is its own only suffix; null entries of the list are
ignored and of repeated entries ``block`` wins over ``allow``; entries of equal length are told apart by the longer host; repeated, null and
tied page_ids are rows of their own; an empty list gives the default everywhere, empty pages no rows; a URL may have any length; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, tune

#: Fixed rules of the registered query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
WORDS = 8


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _bit(key: Column, word: int) -> Column:
    """The bit of a key in a word of its block."""
    return F.shiftright(F.xxhash64(key, F.lit(word + 1)), 58).bitwiseAND(F.lit(63)).cast("int")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int")


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the column ``key``; blocks without keys have no row.  One aggregation, combined before its shuffle."""
    one = F.lit(1).cast("long")
    marked = keys.select(_block(F.col("key"), blocks).alias("block"), *(F.call_function("shiftleft", one, _bit(F.col("key"), w)).alias(f"w{w}") for w in range(WORDS)))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)))


def packed(bloom: DataFrame, blocks: int) -> DataFrame:
    """One row with the filter as an array of ``WORDS * blocks`` words; its size is that of the filter, bounded by ``filter_bytes``."""
    words = F.array(*(F.col(f"w{w}") for w in range(WORDS)))
    held = bloom.agg(F.map_from_entries(F.collect_list(F.struct("block", words.alias("words")))).alias("m"))
    nothing = F.array(*([F.lit(0).cast("long")] * WORDS))
    return held.select(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.coalesce(F.element_at("m", b), nothing))).alias("bits"))


def may_hold(bits: Column, key: Column, blocks: int) -> Column:
    """Whether the filter passes a key: never false for a listed one."""
    first = _block(key, blocks) * WORDS + 1
    return reduce(lambda a, b: a & b, (F.getbit(F.element_at(bits, first + w), _bit(key, w)) == 1 for w in range(WORDS)))


def filter_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", bits_per_url: int = 16, filter_bytes: int = 1 << 20, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict for pages(page_id, url) and listed(host, path, verdict)."""
    spark = pages.sparkSession
    tune(spark)
    known = listed.where("host is not null and path is not null and verdict is not null")
    known = table(known.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", F.concat("host", "path")), "url-list")
    size, lengths = known.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.length("path")))).first()
    blocks = max(1, min(filter_bytes // (8 * WORDS), -(-size * bits_per_url // (64 * WORDS))))
    bits = table(packed(blocked_bloom(known, blocks), blocks), "url-bloom").scalar()

    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    prefixes = F.transform(F.filter(F.lit(lengths or [0]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes(F.col("host")), lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("host"), p.alias("path")))))
    asked = seen.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("k")).select("host", "path", F.col("k.host").alias("lh"), F.col("k.path").alias("lp"))
    possible = asked.where(may_hold(bits, F.concat("lh", "lp"), blocks))
    entries = known.select(F.col("host").alias("lh"), F.col("path").alias("lp"), "verdict")
    entries = F.broadcast(entries) if size <= broadcast_rows else entries.hint("shuffle_hash")
    longest = F.struct((F.length("lh") + F.length("lp")).alias("n"), F.length("lh").alias("h"), F.concat("lh", "lp").alias("rule"), "verdict")
    decided = possible.join(entries, ["lh", "lp"]).groupBy("host", "path").agg(F.max(longest).alias("best"))
    return seen.join(decided, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the fixed rules against every page; nothing listed means allow."""
    rules = F.inline(F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(("host", "path", "verdict"), r))) for r in RULES)))
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.range(1).select(rules))


#: Fixed rules again, as DuckDB's SQL has them.
SQL = r"""
    WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    s AS (
        SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    f AS (
        SELECT s.r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
        FROM s JOIN rules ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p) GROUP BY s.r)
    SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM s LEFT JOIN f ON f.r = s.r"""
