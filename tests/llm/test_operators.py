"""The ten operators against brute force, round trips and held-out accuracy, with null, empty, long, tied and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frostline.llm import decontaminate, language_id, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, textkernel, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, spans string, score double, seed long"


def make(spark, texts, lang="en"):
    """documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, lang if isinstance(lang, str) or lang is None else lang[i], "s", len(t or ""), "x", "y", 1.5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(rng):
    long = prose(rng, 30_000, 5_000)
    base = prose(rng, 120)
    edited = base.split()
    edited[3] = "changed"
    mixed = "Ünïcode　 tëxt\twith\nodd\x0bspace " * 8
    return [None, "", "   \n\t ", "one", "one", "Two words", base, base.upper().lower(), " ".join(edited), base + " " + base, long, long[: len(long) // 2], mixed, "a " * 500, *(prose(rng, rng.randrange(1, 200)) for _ in range(60))]


@pytest.fixture(scope="module")
def texts():
    return awkward(random.Random(3))


def test_words_and_windows():
    t = ["a b  a", "", "x", "é b\nc d a b\nc d", None]
    w = textkernel.words(pa.array(t))
    assert [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end)] == [x for s in t for x in WORD.findall(s or "")]
    at, h = textkernel.windows(w, 2)
    pairs = [(a, b) for s in t for a, b in zip(WORD.findall(s or ""), WORD.findall(s or "")[1:])]
    assert len(at) == len(pairs) and len(set(h.tolist())) == len(set(pairs))


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def near_copies(rng, n, changes):
    """A group in which some pairs link and some do not."""
    base = prose(rng, 150, 3000).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [32, 2])
def test_near_dedup(spark, texts, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 2000)
    all_texts = texts + near_copies(random.Random(5), 60, 22)
    sets = [shingles(t) for t in all_texts]
    want = components(sets)
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(make(spark, all_texts)).collect()}
    assert len(got) == len(all_texts)
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(sets))] == [(len(sets[i]), want[i], want[i] == i) for i in range(len(sets))]


def test_near_dedup_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (2, "a b c d e")]
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, None, True), (2, 2, True), (4, 2, False), (4, 2, False)]
    assert near_dedup.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = a.copy()
    b[:50] = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    values = near_dedup.minhashes(np.array([0, 1000, 2000]), np.concatenate([np.sort(a), np.sort(b)]))
    x, y = near_dedup.odd_sketch(values)
    differing = sum(bin(int(p ^ q)).count("1") for p, q in zip(x, y))
    assert differing <= near_dedup.most_differing(0.8)


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>" + "x" * 300 + "é</p>", "<p>tiny</p>"
    rows = [(5, "http://a/1", big, "z"), (3, "http://a/2\r\nX: y", big, "z"), (9, None, big, "z"), (1, "http://a/3", small, "z"), (2, "http://a/4", small, "z"), (7, "u", None, "z"), (None, "u", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    out = f"file://{tmp_path}/w"
    first = {r["file"]: r["sha256"] for r in warc.write_warc(pages, out, roll_bytes=600).collect()}
    assert len(first) > 1
    again = {r["file"]: r["sha256"] for r in warc.write_warc(pages.repartition(3), f"file://{tmp_path}/again", roll_bytes=600).collect()}
    assert first == again
    key = lambda df: sorted(map(repr, df.select("page_id", "digest", "refers_to").collect()))
    assert key(warc.prepared(pages)) == key(warc.prepared(pages, broadcast_digests=0))
    split = [(r["first_page"], r["last_page"]) for r in warc.write_warc(pages.where("page_id is not null"), f"file://{tmp_path}/split", shard_bytes=900).orderBy("shard", "number").collect()]
    assert len(split) > 2 and all(a[1] < b[0] for a, b in zip(split, split[1:]))
    got = {r["page_id"]: r for r in warc.read_warc(spark, out).collect()}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert {k: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        k: (len((h or "").encode()), digest(h), "revisit" if h == big and k != 3 else "response", 3 if h == big and k != 3 else None) for k, _, h, _ in rows
    }
    assert bytes(got[3]["payload"]).decode() == big and got[7]["payload_bytes"] == 0
    assert warc.read_warc(spark, f"file://{tmp_path}/again").count() == len(rows)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(empty, f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_secret_scan(spark, texts):
    rng = random.Random(2)
    token = lambda n, abc: "".join(rng.choice(abc) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = [f"see {token(40, base64)} here" for _ in range(40)]
    natural = [f"the path /usr/local/share/documents/{i}/thing/of/all/names and word{'a' * 22}{i}" for i in range(40)]
    special = ["Password: 'hunter22' token=ab token: secret=abcdefgh ", "ÄÖ AKIA" + "A1" * 9 + " " + "0123456789abcdef" * 2, "API_KEY = \"" + "x" * 50_000 + "\"", "secret : abc", "k token=api_key=abcdef"]
    all_texts = texts + planted + natural + special
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(make(spark, all_texts)).collect()}
    patterns = (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))
    ok = (lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24)
    for i, t in enumerate(all_texts):
        spans = sorted((m.start(), k, m.end()) for k in range(3) for m in patterns[k].finditer(t or "") if ok[k](m))
        text = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (i, text, got[i])
        assert [got[i][f"n_{k}"] for k in secret_scan.KINDS[:3]] == [sum(x[1] == k for x in spans) for k in range(3)]
    first = len(texts)
    hit = sum(got[i]["n_random"] for i in range(first, first + 40))
    assert hit >= 34 and sum(got[i]["n_random"] for i in range(first + 40, first + 80)) <= 2
    assert secret_scan.secret_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_masking(spark):
    rng = random.Random(12)
    token = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60))
    texts = {
        1: ("a password=abcdefgh b token: 0123456789abcdef0123456789 c", "a [SECRET] b [SECRET] c"), 2: ("clean", "clean"), 3: (None, None), 4: ("", ""),
        5: (f"x\ufdd0y {token} z", "x\ufdd0y [SECRET] z"), 6: ("AKIA" + "A1" * 9 + "TOKEN=abcdefgh end", "[SECRET] end"), 7: ("0123456789abcdef0123456api_key=ZZZZZZZ e", "[SECRET] e"),
        8: ("token=ab stays", "token=ab stays"),
    }
    docs = spark.createDataFrame([(i, t, 5, "mine") for i, (t, _) in texts.items()], "doc_id long, text string, base int, _row string")
    out = secret_scan.secrets(docs, masked="[SECRET]")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: want for i, (_, want) in texts.items()}
    assert out.columns == ["doc_id", "text", "_row", "base", "spans"] and out.first()["_row"] == "mine"


def battery(token):
    """The combined p-value by plain Python."""
    body = token.translate({ord(c): None for c in "-_="})
    enc = next((e for e, p in (("hex", "([0-9a-f]+|[0-9A-F]+)"), ("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("base32", "[A-Z2-7]+"), ("base36", "([0-9a-z]+|[0-9A-Z]+)"), ("base62", "[0-9A-Za-z]+")) if re.fullmatch(p, body)), "base64")
    t = body.lower() if enc in ("hex", "base36") else body
    abc = secret_scan.ALPHABETS[enc]
    n, k, codes = len(t), len(abc), [abc.index(c) for c in t]
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum((codes.count(c) - n / k) ** 2 / (n / k) for c in range(k))
    p = [tail(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))]
    side = [c >= k / 2 for c in codes]
    high = sum(side)
    expect = 2 * high * (n - high) / n + 1
    runs = 1 + sum(a != b for a, b in zip(side, side[1:]))
    z = 9.0 if high in (0, n) else (runs - expect) / math.sqrt(max((expect - 1) * (expect - 2) / (n - 1), 1e-9))
    p.append(2 * tail(abs(z)))
    mean = sum(codes) / n
    spread = sum((c - mean) ** 2 for c in codes)
    z = 9.0 if not spread else (sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / spread + 1 / n) * math.sqrt(n)
    p.append(2 * tail(abs(z)))
    y = -sum(math.log(max(x, 1e-30)) for x in p)
    return enc, n, 0.0 if enc in ("lower", "upper") and n < 24 else min(1.0, math.exp(-y) * (1 + y + y * y / 2))


def test_battery_equals_plain_python(spark):
    rng = random.Random(6)
    abc = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCabc012", "ABCDEFabcdefGHIJKL0123456789+/", "ab-_cD9"]
    tokens = ["".join(rng.choice(a) for _ in range(rng.randrange(20, 90))) for a in abc for _ in range(8)] + ["a" * 30, "usr/local/share/documents", "123e4567-e89b-12d3-a456-426614174000"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secret_scan._battery(F.col("t")).alias("r")).collect()
    for r in got:
        enc, n, p = battery(r["t"])
        assert (r["r"]["enc"], r["r"]["n"]) == (enc, n) and abs(r["r"]["p"] - p) < 1e-4, (r, p)


def test_cuts_pool_sparse_classes():
    cut = secret_scan.cuts
    assert cut([("hex:18", 12, 1)], 0.1) == cut([("hex:18", 6, 1)], 0.1) == {"hex:18": 0.05}
    uniform = [("hex:18", b, 50) for b in range(20)]
    assert cut(uniform, 0.1) == {"hex:18": 0.0}
    natural = [("lower:18", 0, 5000), ("lower:18", 1, 200), ("lower:18", 2, 60)]
    assert cut(natural, 0.1)["lower:18"] > 0.1
    mixed = cut(natural + uniform + [("lower:19", 3, 1)], 0.1)
    assert mixed["hex:18"] <= 0.05 and mixed["lower:19"] > 0.1


def test_secret_scan_of_one_text_with_many_tokens(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(20_000))
    got = secret_scan.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = ",".join(f"hex:{33 * i}:{33 * i + 32}" for i in range(20_000))
    assert got["n_hex"] == 20_000 and got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_quality_rules_base_counts(spark, texts):
    special = ["line one\nline one\n\n \nline one", "# * $ % & | < > é", "a b c d e a b c d e x"]
    all_texts = texts + special
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(make(spark, all_texts, None), min_group=10).collect()}
    for i, t in enumerate(all_texts):
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        count = Counter(grams)
        covered = {k for j, g in enumerate(grams) if count[g] > 1 for k in range(j, j + 5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
        assert tuple(got[i][c] for c in quality_rules.BASE) == want
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_outliers_are_rejected(spark):
    rng = random.Random(4)
    clean = [prose(rng, rng.randrange(80, 200)) for _ in range(150)]
    junk = [" ".join(x + "###" for x in prose(rng, 100).split()) for _ in range(6)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(make(spark, clean + junk)).collect()}
    assert sum(got[i] for i in range(150)) >= 147 and not any(got[i] for i in range(150, 156))


def test_packing_places_every_token(spark, texts):
    got = packing.pack(make(spark, texts), shard_tokens=4000).collect()
    per, bins = {}, {}
    for r in got:
        per.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
    for i, t in enumerate(texts):
        pieces = sorted(per[i])
        assert sum(n for _, n in pieces) == len(WORD.findall(t or "")) + 1
        assert [f for f, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1])
    for rows in bins.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1])
        filled = sum(r["n_tokens"] for r in rows)
        assert {r["bin_tokens"] for r in rows} == {filled}
        assert {r["capacity"] for r in rows} == {min(c for c in packing.CAPACITIES if c >= filled)}
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def least_cost(sizes, capacities, overhead, attention):
    """Least total cost of any packing, over all ways to part the pieces."""
    caps = sorted(capacities)
    cost = packing.bin_cost(caps, overhead, attention)
    held = [sum(n for i, n in enumerate(sizes) if m >> i & 1) for m in range(1 << len(sizes))]
    best = [0.0] * len(held)
    for m in range(1, len(held)):
        low, best[m] = m & -m, float("inf")
        rest = part = m ^ low
        while True:
            if held[part | low] <= caps[-1]:
                best[m] = min(best[m], cost[np.searchsorted(caps, held[part | low])] + best[rest ^ part])
            if not part:
                break
            part = (part - 1) & rest
    return best[-1]


def test_packing_comes_near_the_optimum():
    rng, ratio, caps = np.random.default_rng(5), [], [8, 16, 32, 64]
    for _ in range(150):
        sizes = np.sort((rng.integers(1, 65, rng.integers(1, 9)) * rng.random() + 1).astype(int).clip(1, 64))[::-1]
        where, offset, got = packing.best_fit(sizes, caps, 2, 384)
        filled = np.bincount(where, sizes)
        assert (got == [min(c for c in caps if c >= f) for f in filled]).all()
        for b in range(len(got)):
            at = sorted(zip(offset[where == b], sizes[where == b]))
            assert [o for o, _ in at] == np.cumsum([0, *(n for _, n in at)])[:-1].tolist()
        ratio.append(packing.bin_cost(got, 2, 384).sum() / least_cost(sizes.tolist(), caps, 2, 384))
    assert min(ratio) > 1 - 1e-9 and max(ratio) < 1.25 and np.mean(np.array(ratio) < 1 + 1e-9) > 0.9


def test_packing_chooses_each_length_by_its_cost():
    few, many = np.full(4, 250), np.full(400, 250)
    assert set(packing.best_fit(many, packing.CAPACITIES, 16)[2].tolist()) == {512}  # attention outweighs the fixed part of two more bins
    assert set(packing.best_fit(many, packing.CAPACITIES, 500)[2].tolist()) == {4096}  # 25 bins of 5 278.7 against 50 of 2 718.7 cost less
    assert packing.best_fit(few, packing.CAPACITIES, 1e6)[2].tolist() == [1024]
    assert packing.best_fit(np.zeros(0, int), packing.CAPACITIES, 16)[2].tolist() == []


def test_best_fit_takes_the_tightest_bin():
    where, offset, caps = packing.best_fit(np.array([90, 60, 50, 40, 10]), [100], 0)
    assert where.tolist() == [0, 1, 2, 1, 0] and offset.tolist() == [0, 0, 0, 60, 90] and caps.tolist() == [100, 100, 100]
    assert packing.best_fit(np.array([30]), [32, 64, 128], 0)[2].tolist() == [32]


def languages(rng, n):
    parts = {"aa": ["tha", "ing", "er", "on", "wh"], "bb": ["ción", "os", "ue", "lla", "ñe"], "cc": ["sch", "ung", "ein", "keit", "ß"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))]
        out.append((lang, " ".join(words).capitalize() + "."))
    return out


def test_language_id(spark):
    rows = languages(random.Random(6), 300)
    texts = [t for _, t in rows] + [None, "", "123 456 !!", "一二三", "— …"]
    lang = [x for x, _ in rows] + [None] * 5
    got = {r["doc_id"]: r for r in language_id.language_id(make(spark, texts, lang)).collect()}
    assert len(got) == len(texts)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(300))
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.98 * len(held)
    assert [got[i]["lang_pred"] for i in (300, 301, 302, 304)] == ["und"] * 4 and got[303]["lang_pred"] in ("aa", "bb", "cc")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["lang_pred"] == "und" for r in language_id.language_id(make(spark, ["abc def"], None)).collect())


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([("aa", "abra cadabra abba " * 3), ("aa", "bad cab"), ("bb", "zz zy")], "lang string, text string")
    model = language_id.train(docs)
    # every context: the probabilities of all characters seen, and the mass of unseen ones, stay within 1
    for context in ("", "a", "ab", "abra"):
        total = sum(2.0 ** (model.bits([context + c])[0][0, 0] - _before(model, context, c)) for c in "abcdrzy")
        assert total <= 1 + 1e-5


def kneser_ney(texts, run, order=5):
    """log2 probability of a padded run by plain interpolated Kneser-Ney."""
    grams = Counter()
    for r in " ".join(texts).split():
        r = f" {r} "
        for e in range(1, len(r)):
            for n in range(1, min(order, e + 1) + 1):
                grams[r[e - n + 1 : e + 1], e - n + 1 == 0] += 1
    opens = {g for g, o in grams if o}
    plain = Counter()
    for (g, _), c in grams.items():
        plain[g] += c
    cont = Counter(g[1:] for g in plain if len(g) > 1)
    c = {g: x if g in opens or not cont[g] else cont[g] for g, x in plain.items()}
    seen = {n: [x for g, x in c.items() if len(g) == n] for n in range(1, order + 1)}
    d = {n: min(max(x.count(1) / max(x.count(1) + 2 * x.count(2), 1), 0.1), 0.9) for n, x in seen.items()}
    total, kinds = Counter(), Counter()
    for g, x in c.items():
        total[len(g), g[:-1]] += x
        kinds[len(g), g[:-1]] += 1

    def p(g):
        n, below = len(g), p(g[1:]) if len(g) > 1 else 1 / 2048
        t = total[n, g[:-1]]
        return (max(c.get(g, 0) - d[n], 0) + d[n] * kinds[n, g[:-1]] * below) / t if t else below

    run = f" {run} "
    return sum(math.log2(p(run[max(0, e - order + 1) : e + 1])) for e in range(1, len(run)))


def test_rare_language_beside_a_hot_one_keeps_its_ngrams(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 10)))
    hot = [" ".join(word() for _ in range(300)) for _ in range(200)]
    own = [word() for _ in range(40)]
    rare = [" ".join(rng.choices(own, k=20)) for _ in range(6)]
    docs = spark.createDataFrame([("hot", t) for t in hot] + [("rare", t) for t in rare], "lang string, text string").repartition(4)
    model = language_id.train(docs)
    counted = docs.where(~language_id.held_for_calibration(5)).collect()
    rare, hot = ([r["text"] for r in counted if r["lang"] == x] for x in ("rare", "hot"))
    assert 2 <= len(rare) < 6
    for run in (own[0], own[1] + own[2], "zzz"):
        assert math.isclose(model.bits([run])[0][0, model.langs.index("rare")], kneser_ney(rare, run), rel_tol=1e-4)
    assert math.isclose(model.bits([own[3]])[0][0, model.langs.index("hot")], kneser_ney(hot, own[3]), rel_tol=1e-4)
    texts = [*hot[:20], *rare, " ".join(own[:8]), None, "", "12", own[5]]
    rows = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [sorted(map(str, language_id.identify(rows, m).collect())) for m in (model, language_id.train(docs, broadcast_numbers=0))]
    assert got[0] == got[1]
    assert {r["lang_pred"] for r in language_id.identify(rows.where(f"doc_id > 20 and doc_id <= {20 + len(rare)}"), model).collect()} == {"rare"}


def _before(model, context, c):
    """Bits of all of ' context c ' but c itself."""
    code, opening, _ = language_id._padded([context + c])
    whole = model.bits([context + c])[0][0, 0]
    at = len(context)
    parts = []
    base = textkernel.mix(code + textkernel.U(0x51ED2701))
    for i in range(1, len(code)):
        n, extra = min(i + 1, language_id.ORDER), 0.0
        while True:
            h = textkernel.rolling(base[i - n + 1 : i + 1], n)[0]
            keys, p = model.grams[n]
            j = int(np.searchsorted(keys, h))
            if j < len(keys) and keys[j] == h:
                parts.append(extra + float(p[j, 0]))
                break
            if n == 1:
                parts.append(extra - 11)
                break
            ctx = textkernel.rolling(base[i - n + 1 : i], n - 1)[0]
            cs, g = model.back[n]
            j = int(np.searchsorted(cs, ctx))
            extra += float(g[j, 0]) if j < len(cs) and cs[j] == ctx else 0.0
            n -= 1
    assert math.isclose(sum(parts), whole, abs_tol=1e-3)
    return whole - parts[at]


def test_decontamination(spark):
    rng = random.Random(8)
    items = [prose(rng, rng.randrange(30, 80), 4000) for _ in range(12)] + [None, "", "two words"]
    copy = items[0]
    edited = items[1].split()
    for k in range(5, len(edited), 9):
        edited[k] = "other"
    del edited[12]
    texts = [prose(rng, 200, 4000) for _ in range(40)]
    texts[3] = prose(rng, 50, 4000) + " " + copy.upper() + ", " + prose(rng, 50, 4000)
    texts[7] = prose(rng, 50, 4000) + " " + " ".join(edited) + " " + prose(rng, 50, 4000)
    texts += [None, "", copy]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for options in ({}, {"broadcast_seeds": 0}):
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.decontamination(make(spark, texts), bench, **options).collect()}
        assert set(got) == {(3, 0), (7, 1), (42, 0)}, options
        assert got[3, 0] == 1.0 and 0.5 < got[7, 1] < 1
    assert decontaminate.decontamination(make(spark, texts), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_joined_equals_broadcast(spark):
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(8))
    items = [(i, f"x{i} y{i} {common} z{i} v{i}") for i in range(3)] + [(None, prose(rng, 30, 4000)), (7, prose(rng, 40, 4000)), (7, prose(rng, 40, 4000))]
    items += [items[0], (8, "two words"), (9, None)]
    rows = [(i, " ".join(common + " " + prose(rng, 5, 4000) for _ in range(3))) for i in range(40)]  # in 40 rows, 120 times
    rows += [(None, items[0][1]), (None, items[0][1]), (None, items[3][1]), (50, items[4][1]), (50, items[4][1]), (50, items[5][1] + " " + items[1][1]), (None, None), (51, None), (52, "so two words here")]
    rows += [(60, prose(rng, 30, 4000) + " " + " ".join(w for k, w in enumerate(items[4][1].split()) if k % 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(map(str, decontaminate.decontamination(docs, bench, **o).collect())) for o in ({}, {"broadcast_seeds": 0})]
    assert got[0] == got[1]
    ids = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.decontamination(docs, bench, broadcast_seeds=0).collect())
    assert (ids[None, 0], ids[None, None], ids[50, 7], ids[50, 1], ids[52, 8], ids[60, 7]) == (2, 1, 3, 1, 1, 1)
    # the phrase is frequent: it leads to item 2 alone, of which the corpus has nothing rarer
    assert {i for d, i in ids if d is not None and d < 40} == {2}


def test_alignment_equals_full_matrix():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12).astype(np.uint64), rng.integers(0, 4, 15).astype(np.uint64)
        h = np.zeros((13, 16), int)
        for i in range(12):
            for j in range(15):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def ngram_counts(tokens, rows):
    one, two, three, starts = Counter(), Counter(), Counter(), 0
    for i in rows:
        t = tokens[i]
        starts += 1
        one.update(t)
        two.update(zip([None, *t], t))
        three.update(zip([None, *t], t, t[1:]))
    return one, two, three, one | Counter({None: starts})


def mixed(counts, total, weights, u, v, w):
    """(P1, bigram and trigram estimates, counts of both contexts) of w behind v behind u; u is False for a text's first token."""
    one, two, three, contexts = counts
    n = sum(one.values())
    p1 = weights.unigram * one[w] / n + (1 - weights.unigram) / (total + 1)
    cv, cuv = contexts[v], 0 if u is False else two[u, v]
    return p1, two[v, w] / cv if cv else 0, three[u, v, w] / cuv if cuv else 0, cv, cuv


def test_lm_score(spark, texts):
    rng = random.Random(21)
    chain = lambda n: " ".join(f"c{k % 7} d{(k * k) % 5}" for k in range(rng.randrange(50), rng.randrange(60, 60 + n)))
    texts = texts + [chain(40) for _ in range(60)] + [texts[6], texts[6]]
    docs = make(spark, texts)
    got = {r["doc_id"]: r for r in lm_scoring.lm_score(docs, block_bytes=20_000).collect()}
    weights = lm_scoring.fit(docs, block_bytes=200_000)[2]
    tokens = [WORD.findall((t or "").translate(LOWER)) + ["\n"] for t in texts]
    part = [zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))]
    of = lambda keep: ngram_counts(tokens, [i for i in range(len(texts)) if keep(part[i])])
    every, kept = of(lambda p: p != 1), of(lambda p: p > 1)
    n, v = sum(every[0].values()), len(every[0])
    each = lambda t: zip([False, None, *t], [None, *t], t)
    bucket = lambda c: c.bit_length()
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (part[i] == 1, len(t), sum(x in every[0] for x in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((every[0][x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel_tol=1e-9)
        want = 0.0
        for x in each(t):
            p1, p2, p3, cv, cuv = mixed(every, v, weights, *x)
            p2 = weights.two[bucket(cv)] * p2 + (1 - weights.two[bucket(cv)]) * p1
            want += math.log10(weights.three[bucket(cuv)] * p3 + (1 - weights.three[bucket(cuv)]) * p2)
        assert math.isclose(r["score"], want, rel_tol=1e-9), i
    # expectation-maximisation on the events themselves
    unigram, two, three = [], {}, {}
    for i, t in enumerate(tokens):
        for x in each(t) if part[i] == 0 else []:
            p1, p2, p3, cv, cuv = mixed(kept, v, weights, *x)
            unigram.append(kept[0][x[2]] / sum(kept[0].values()) * (v + 1))
            two.setdefault(bucket(cv), []).append(p2 / p1)
            lower = weights.two[bucket(cv)] * p2 / p1 + 1 - weights.two[bucket(cv)]
            three.setdefault(bucket(cuv), []).append(p3 / p1 / lower)
    em = lambda r: lm_scoring.em_weight(np.array(r), np.ones(len(r)))
    assert abs(em(unigram) - weights.unigram) < 0.03 and len(two) > 3 and len(three) > 3
    for exact, learned in ((two, weights.two), (three, weights.three)):
        for k, r in exact.items():
            assert k == 0 or len(r) < 30 or abs(em(r) - learned[k]) < 0.06, (k, em(r), learned[k])
    assert lm_scoring.lm_score(spark.createDataFrame([], SCHEMA)).count() == 0
    lonely = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = lm_scoring.lm_score(spark.createDataFrame([(lonely, "a b")], "doc_id long, text string")).first()
    assert (alone["train_tokens"], alone["n_known"], alone["score"]) == (0, 0, 0.0)


def test_em_finds_the_mixture():
    # ratio 4 in 700 events and 0 in 300: the likelihood peaks where 700 * 3 / (1 + 3 w) = 300 / (1 - w)
    w = lm_scoring.em_weight(np.array([4.0, 0.0]), np.array([700.0, 300.0]))
    assert abs(700 * 3 / (1 + 3 * w) - 300 / (1 - w)) < 1
    out = lm_scoring.em_weights(np.array([3, 3]), np.array([4.0, 0.0]), np.array([700.0, 300.0]))
    assert out[3] == w == out[9] and out[0] == out[2] == 0


def test_packed_counts():
    for x in ([], [0], [1, 254, 255, 256, 3, 1 << 40], list(range(1000))):
        assert lm_scoring.unpack(lm_scoring.pack(np.array(x, np.int64))).tolist() == x


def test_packed_hashes():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 1000):
        h = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
        assert (lm_scoring.unpack_sorted(lm_scoring.pack_sorted(h)) == h).all()


def test_substring_dedup(spark, texts):
    rng = random.Random(9)
    passage = prose(rng, 60, 9000)
    shared = [prose(rng, 40, 9000) + " " + passage + " " + prose(rng, 40, 9000) for _ in range(15)]
    inside = prose(rng, 20, 9000) + " " + passage + " " + passage
    almost = " ".join(passage.split()[:34])
    all_texts = texts + shared + [inside, almost, passage.upper()]
    words = [WORD.findall(t or "") for t in all_texts]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(make(spark, all_texts), shard_bytes=20_000, salt_bytes=2_000).collect()}
    assert len(got) == len(all_texts)
    for i, w in enumerate(words):
        gone = {k for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_substring_dedup_cuts_long_passages_into_pieces(spark):
    rng = random.Random(21)
    body = prose(rng, 3_000, 9000)
    turn = prose(rng, 40, 9000) + " "
    all_texts = ["a " + body + " b", "c d " + body.replace(body.split()[1500], "changed"), prose(rng, 500, 9000), " ".join(body.split()[700:1900]), turn * 60, "x " + turn * 3, "same " * 900]
    words = [t.split() for t in all_texts]
    count = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for stretch in (1, 36, 200):
        got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(make(spark, all_texts), shard_bytes=5_000, salt_bytes=1_000, stretch=stretch).collect()}
        for i, w in enumerate(words):
            gone = {k for j in range(len(w) - 34) if count[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
            kept = " ".join(x for k, x in enumerate(w) if k not in gone)
            assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone), hashlib.sha256(kept.encode()).hexdigest()), (stretch, i)


def test_substring_dedup_null_and_repeated_ids(spark):
    rng = random.Random(12)
    a, b = prose(rng, 50, 9000), prose(rng, 50, 9000)
    rows = [(None, a + " x"), (None, "y " + a), (7, b), (7, b), (7, prose(rng, 40, 9000)), (8, b + "  z")]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 51, 50), (-1, 51, 50), (7, 40, 0), (7, 50, 50), (7, 50, 50), (8, 51, 50)]


def test_quality_classifier(spark):
    rng = random.Random(10)
    good = [prose(rng, rng.randrange(20, 300)).capitalize() + "." for _ in range(120)]
    bad = [" ".join(x + rng.choice(["###", "%%%", "***"]) for x in prose(rng, rng.randrange(20, 300)).split()) for _ in range(60)]
    texts = [x for t in zip(good[:60], bad) for x in t] + good[60:] + [None, ""]
    y = [1, 0] * 60 + [1] * 60
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(y)] + [(None, 1, 0), (500, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier.quality_classifier(make(spark, texts), labels).collect()}
    held = [i for i in range(180) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) for i in range(180))
    assert sum(got[i]["predicted"] == y[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values()) and len(got) == len(texts)
    none = quality_classifier.quality_classifier(make(spark, ["a"]), labels.where("false")).first()
    assert none["score"] == 0.5


def test_attention_gradient():
    rng = np.random.default_rng(3)
    m = quality_classifier.Model()
    first, y = np.array([0, 2, 3, 6]), np.array([1.0, 0.0, 1.0])
    x = rng.standard_normal((6, quality_classifier.FEATURES))
    loss = lambda: float(-(y * np.log(m.forward(x, first)["y"]) + (1 - y) * np.log(1 - m.forward(x, first)["y"])).mean())
    grad = m.gradient(m.forward(x, first), y, first)
    for k, p in m.p.items():
        at = tuple(0 for _ in p.shape)
        was = p[at]
        p[at] = was + 1e-5
        up = loss()
        p[at] = was - 1e-5
        down = loss()
        p[at] = was
        assert math.isclose(grad[k][at], (up - down) / 2e-5, rel_tol=1e-3, abs_tol=1e-8), k


def test_operators_read_only_their_columns(spark, texts):
    bare = make(spark, texts[:12]).select("doc_id", "text")
    assert near_dedup.near_dedup(bare).count() == 12
    assert packing.pack(bare, tokens=F.length(F.coalesce("text", F.lit("")))).select("doc_id").distinct().count() == 12


def test_near_dedup_repeated_ids_of_differing_texts(spark):
    rng = random.Random(8)
    a, b = prose(rng, 60, 3000), prose(rng, 60, 3000)
    rows = [(5, a), (5, b), (9, b + " more"), (8, a + " more"), (7, prose(rng, 60, 3000)), (5, a)]
    out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(5, 5), (5, 5), (5, 5), (7, 7), (8, 5), (9, 5)]
    assert len({r["component"] for r in out if r["first"]}) == 3 and sum(r["first"] for r in out) == 4


def test_join_classes_splits_heavy_keys(spark, monkeypatch):
    from frostline.llm import common

    monkeypatch.setattr(common, "HEAVY_KEYS", 4)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3] * 2 + [9])], "k long, i long")
    classes = spark.createDataFrame([(1, 50, "a"), (2, 3, "b"), (3, 2, "c")], "k long, n long, v string")
    got = sorted((r["i"], r["v"]) for r in common.join_classes(rows, classes, ["k"], "n", 56).collect())
    assert got == [(i, "a" if i < 50 else "b" if i < 53 else "c" if i < 55 else None) for i in range(56)]


def test_warc_wide_and_outlying_ids(spark, tmp_path):
    html = lambda i: f"<p>{i}</p>" * 40
    rows = [(i, "u", html(i)) for i in (-(1 << 62) - 5, (1 << 62) + 5, -(1 << 63) + 1, (1 << 63) - 1)] + [(i, "u", html(i)) for i in range(200)] + [(1 << 60, f"u{k}", html(k)) for k in range(100)] + [(None, "n", None), (3, "u", html(3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = f"file://{tmp_path}/w"
    files = warc.write_warc(pages, out, shard_bytes=20_000).collect()
    assert len({r["shard"] for r in files}) >= 8 and max(r["records"] for r in files) < 80
    got = sorted(((r["page_id"] or 0, r["payload_bytes"]) for r in warc.read_warc(spark, out).collect()))
    assert got == sorted((i or 0, len(h or "")) for i, _, h in rows)
    again = warc.write_warc(pages.repartition(5), f"file://{tmp_path}/again", shard_bytes=20_000).collect()
    assert {(r["file"], r["sha256"]) for r in again} == {(r["file"], r["sha256"]) for r in files}
    (tmp_path / "w" / "manifest" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="no committed manifest"):
        warc.read_warc(spark, out)


def test_warc_members_are_read_in_linear_time():
    import time

    def seconds(n):
        data = b"".join(warc.member([("WARC-Type", "resource")], bytes([i % 251]) * 900) for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.members(data)) == n
        return time.process_time() - began

    seconds(200)
    assert seconds(8000) < 12 * max(seconds(2000), 0.01)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(warc.member([], b"x" * 500)[:-5]))


def test_packing_deals_a_heavy_id_over_shards(spark):
    rows = [(7, "w " * 50)] * 3000 + [(None, "v " * 50)] * 2000 + [(i, "u " * 40) for i in range(100, 300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), shard_tokens=20_000)
    load = {r["shard"]: r["t"] for r in out.groupBy("shard").agg(F.sum("n_tokens").alias("t")).collect()}
    assert sum(load.values()) == 3000 * 51 + 2000 * 51 + 200 * 41 and max(load.values()) < 70_000 and len(load) > 6
    assert out.where("offset = 0").groupBy("shard", "bin").count().where("count > 1").count() == 0


def test_decontamination_of_long_items_and_repeated_ids(spark):
    rng = random.Random(31)
    long = prose(rng, 17_000, 9_000)
    part = " ".join(long.split()[:15_000])
    docs = spark.createDataFrame([(1, f"{prose(rng, 20)} {part}"), (None, part), (2, prose(rng, 300)), (1, part), (1, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(5, long), (6, None), (6, ""), (None, long)], "item_id long, text string")
    key = lambda df: sorted((r["doc_id"] or 0, r["item_id"] or 0, r["seed_hits"], round(r["score"], 6), r["first_word"], r["end_word"]) for r in df.collect())
    got = key(decontaminate.contaminated(docs, items))
    assert [x[:2] for x in got] == [(0, 0), (0, 5), (1, 0), (1, 0), (1, 5), (1, 5)] and all(x[3] > 0.8 for x in got)
    assert key(decontaminate.contaminated(docs, items, broadcast_words=0)) == got


def test_classifier_sample_is_bounded(spark, monkeypatch):
    rng = random.Random(32)
    docs = spark.createDataFrame([(i, prose(rng, 2000)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_classifier.Model, "fit", lambda self, x, first, y, **k: seen.append((len(x), len(y))) or self)
    for options in ({}, {"sample_passages": 300}, {"sample_rows": 5}):
        quality_classifier.train(docs, labels, **options)
    assert seen[0][1] > 30 and seen[1][0] <= 500 and seen[2][1] <= 12


def mcd(x, support=0.75, steps=6):
    """The estimate of one group in NumPy: (distances rescaled, log determinant of each start after the trials)."""
    q, p = quality_rules, quality_rules.P
    lower = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    median = lower(x)
    floor = np.maximum(q.FLOOR, q.SHARE * 1.4826 * lower(np.abs(x - median)))

    def fit(v, factor):
        cov = factor * np.cov(v.T, bias=True)
        return v.mean(axis=0), cov + np.diag(np.maximum(floor**2 - np.diag(cov), 0) + 1e-9)

    def step(mean, cov):
        d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)
        bins = np.minimum(1023, np.floor(16 * np.log2(1 + d)))
        before = np.array([(bins < b).sum() for b in bins])
        return fit(x[before < support * len(x)], q.consistency(support))

    ends = []
    for e in ((median, np.diag(floor**2)), fit(x, 1), fit(np.clip(x, median - 2 * floor, median + 2 * floor), 1)):
        for _ in range(q.TRIALS):
            e = step(*e)
        ends.append(e)
    dets = [np.linalg.slogdet(c)[1] for _, c in ends]
    e = ends[int(np.argmin(dets))]
    for _ in range(steps - q.TRIALS):
        e = step(*e)
    d = ((x - e[0]) @ np.linalg.inv(e[1]) * (x - e[0])).sum(axis=1)
    return d * min(1, q.chi2_quantile(0.0) / lower(d)), dets


def test_mcd_equals_numpy_and_small_sources_use_their_language(spark):
    rng = random.Random(41)
    bad = lambda: "### $$$ %%% " * rng.randrange(5, 40)
    rows = [(i, bad() if i % 5 == 0 else prose(rng, rng.randrange(40, 400)) + " A1" * rng.randrange(6), "en", "tiny" if i < 5 else "big") for i in range(201)]
    rows += [(300 + i, prose(rng, 50), "de", None) for i in range(4)] + [(400, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality_rules.mcd_outliers(docs, steps=6, settled=0.0).collect()}
    assert len(out) == len(rows) and {r["key"] for r in out.values()} == {"ls\x01en\x01big", "l\x01en", "all"}
    vector = lambda i: [out[i][c] for c in quality_rules.STATS]
    for key, members in (("ls\x01en\x01big", range(5, 201)), ("l\x01en", range(201)), ("all", out)):
        want, _ = mcd(np.array([vector(i) for i in members]))
        for i, d in zip(members, want):
            if out[i]["key"] == key:
                assert math.isclose(out[i]["distance2"], d, rel_tol=0.02, abs_tol=1e-6), (key, i, out[i]["distance2"], d)
    assert all(out[i]["outlier"] for i in range(5, 201) if i % 5 == 0) and sum(out[i]["outlier"] for i in range(5, 201) if i % 5) <= 8
    assert quality_rules.mcd_outliers(docs.where("false")).count() == 0
    assert abs(quality_rules.consistency(0.75) - 1.30) < 0.03 and quality_rules.consistency(1) == 1


def test_language_id_calibrates_on_the_whole_fold_and_counts_every_row(spark):
    docs = spark.range(12_000, numPartitions=4).selectExpr("if(id % 3 = 0, 'aa', 'bb') AS lang", "concat_ws(' ', if(id % 3 = 0, 'abra kadabra', 'zyx wvu'), hex(xxhash64(id div 2)), if(id % 3 = 0, 'abba', 'xyz')) AS text")
    model = language_id.train(docs)
    fold = docs.where(language_id.held_for_calibration(5)).distinct().collect()
    assert len(fold) > 1_500
    for i, lang in enumerate(model.langs):
        own = model.entropy(pa.array([r["text"] for r in fold if r["lang"] == lang]))[0][:, i]
        assert math.isclose(model.reject[i], np.quantile(own, 0.999) + 0.5, rel_tol=1e-9)
    held = spark.range(200).selectExpr("'qq' AS lang", "concat('qoqo quq ', id) AS text").where(language_id.held_for_calibration(5)).limit(5)
    whole = language_id.train_whole(docs.limit(50).unionByName(held))
    assert "qq" in whole.langs and whole.reject[whole.langs.index("qq")] == np.inf
    rows = spark.createDataFrame([(1, "qoqo quq")], "doc_id long, text string")
    assert language_id.identify(rows, whole).first()["lang_pred"] == "qq"
