"""Collocations, URL filters and ranked search against brute force, with null, empty, long, tied and repeated rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from frostline.llm import collocations, lexical_search, url_filter

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, f long, w1 long, score double, depth int, rank int, query long, phrase string"


def documents(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, 1, 2, 0.5, 3, 4, 5, "x") for i, t, lang in rows], DOCS)


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" + rng.choice(["", "", "", "", ".", ",", "\n"]) for _ in range(n))


def mined(rows, least, top, longest):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                around[lang, p[i : i + m]] = max(around[lang, p[i : i + m]], a)
    out = {}
    for (lang, p), a in candidates.items():
        if 100 * around[lang, p] < 50 * a:
            score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


@pytest.mark.parametrize("trie_words, filter_bits, longest", [(1 << 22, 1 << 20, 3), (500, 1 << 20, 3), (500, 64, 4)])
def test_collocations(spark, trie_words, filter_bits, longest):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 300)), rng.choice(["en", "de", "en", None])) for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, " \t ", None), (103, prose(rng, 20_000, 4_000), "en"), (None, "The Cat sat.", "fr"), *[(104, "the cat sat on the mat, the cat sat", "fr")] * 12]
    rows += [(105, "Ünï çödé　x " * 15, ""), (106, "\x00a \x01b " * 20, "en")]
    got = collocations.collocations(documents(spark, rows), max_words=longest, top=40, trie_words=trie_words, filter_bits=filter_bits)
    assert got.columns == "lang rank phrase a l r n score".split()
    assert sorted(map(tuple, got.collect())) == mined(rows, 10, 40, longest)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(1, None, None), (2, "one two", "en")])).count() == 0


def test_ranges_that_begin_below_their_ancestors(spark):
    """Many ranges over one first word: left parts come from earlier ranges."""
    rows = [(i, " . ".join(f"hub w{k} w{j}" for k in range(30) for j in range(3)), "en") for i in range(12)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = collocations.collocations(documents(spark, rows), top=1000)
        assert sorted(map(tuple, got.collect())) == mined(rows, 10, 1000, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def judged(url, rules):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = host.translate(LOWER)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


PAGES = "page_id long, url string, html string, host string, path string, verdict string, k long, best string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", "y", "z", 1, "b") for i, u in urls], PAGES)


@pytest.mark.parametrize("broadcast_rows, filter_bytes", [(100_000, 1 << 20), (0, 1 << 20), (0, 64)])
def test_url_filter(spark, broadcast_rows, filter_bytes):
    rng = random.Random(9)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.b.example.net", "com", "net", "notexample.com", "", "u@example.com:80", "example.com.", "..com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/1", "/fr/?q#f", "/EN/", "?x=/en/", "#/fr/", "/en//x", "/a://b/en/"]
    urls = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(300)] + [(400, None), (401, ""), (402, "no scheme"), (None, "https://www.example.com/en/1"), (403, "x://net/es/" + "y" * 50_000), (403, "x://net/es/"), (404, "http://example.com\n/en/")]
    urls += [(405, "http://shop.example.com/en/1")] * 50
    listed = [(f"h{i}.org", f"/p{i % 7}", "block") for i in range(500)]
    urls += [(500 + i, f"http://sub.h{i}.org/p{i % 7}x") for i in range(50)]
    for rules in (list(url_filter.RULES), [*url_filter.RULES, *listed]):
        frame = spark.createDataFrame([*rules, (None, "/", "block"), ("example.com", None, "block")], "host string, path string, verdict string")
        got = url_filter.filter_urls(pages(spark, urls), frame, broadcast_rows=broadcast_rows, filter_bytes=filter_bytes)
        assert got.columns == "page_id host path rule verdict".split()
        key = lambda r: tuple((x is None, x or 0 if i == 0 else x or "") for i, x in enumerate(r))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *judged(u, rules)) for i, u in urls), key=key)
    assert url_filter.filter_urls(pages(spark, []), frame).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages(spark, urls), frame.where("false"), default="block").collect()} == {"block"}


def test_bloom_passes_listed_keys_and_few_others(spark):
    keys = spark.range(2_000).selectExpr("concat('k', id) AS key")
    blocks = 2_000 * 16 // 512
    bits = url_filter.packed(url_filter.blocked_bloom(keys, blocks), blocks).scalar()
    tried = spark.range(20_000).selectExpr("id", "concat('k', id) AS key").withColumn("may", url_filter.may_hold(bits, F.col("key"), blocks))
    passed = tried.where("may")
    assert passed.where("id < 2000").count() == 2_000 and passed.where("id >= 2000").count() < 400
    url_filter_plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in url_filter_plan and "Arrow" not in url_filter_plan


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    bags = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t, _ in docs if t is not None]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        terms = {t for t in TERM.findall((text or "").translate(LOWER)) if t in df}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scores = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total
            s = sum(w[t] * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in terms & b.keys())
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def by(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("postings, terms, k", [(250_000, 1_000_000, 50), (300, 100, 5), (300, 7, 1)])
def test_search(spark, postings, terms, k):
    rng = random.Random(7)
    docs = [(i, prose(rng, rng.randrange(1, 120), 300), "en") for i in range(400)]
    docs += [(500, None, "en"), (501, "", "en"), (502, " .,- ", "en"), (None, "w1 w2 rare", "en"), (503, prose(rng, 20_000, 5_000), "en"), (504, "Éclair 東京 éclair x_y-z", "en"), *[(505, "same same words w299", "en")] * 3]
    items = [(i, prose(rng, rng.randrange(1, 30), 300)) for i in range(25)] + [(30, None), (31, ""), (32, "unheard of"), (33, "same RARE éclair 東京 y"), (33, "w1"), (None, "w2 w3"), (34, prose(rng, 4_000, 5_000))]
    frame = spark.createDataFrame([(i, t, 1, 2.0, "q") for i, t in items], "item_id long, text string, doc_id long, score double, query string")
    got = lexical_search.search(documents(spark, docs), frame, k, postings, terms)
    assert got.columns == "item_id rank doc_id score".split()
    assert sorted(map(tuple, got.collect()), key=by) == sorted(ranked(docs, items, k), key=by)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(documents(spark, []), items).count() == 0
    assert lexical_search.search(documents(spark, [(1, "a", "en")]), items.where("false")).count() == 0
    assert lexical_search.search(documents(spark, [(1, None, "en")]), items).count() == 0


def test_search_stops_before_the_last_postings(monkeypatch):
    """A rare strong term decides; the postings of the common one are left alone."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [(i, 40, np.array([1, 2] if i < 30 else [2], np.uint64).tobytes(), (rng.integers(1, 9, 2) if i < 30 else np.ones(1, np.int64)).astype(np.int64).tobytes()) for i in range(20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc_id", "n", "terms", "tf"])
    shard = lexical_search.Shard(next(lexical_search._shards(iter([batch]), 20_000, 800_000, 1 << 30)).to_pylist()[0])
    asked = []
    complete = shard.complete
    monkeypatch.setattr(shard, "complete", lambda *x: asked.append(x[0]) or complete(*x))
    docs, score = shard.search(np.array([1, 2], np.uint64), np.array([6500, 3]), 10)
    every = sorted(((-complete(d, np.array([1, 2], np.uint64), np.array([6500, 3])), d) for d in range(30)))[:10]
    assert [(-s, d) for s, d in zip(score.tolist(), docs.tolist())] == every
    assert 0 < len(asked) <= 64
