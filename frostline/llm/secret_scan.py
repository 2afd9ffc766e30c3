"""Secret scans in DataFrame functions only: fixed patterns, and a randomness test battery for everything else that looks encoded.

Candidates are whole runs of 20 or more base64-like characters in the text with base matches blanked out, so what a base match leaves of a run is judged by
itself.  '-' and '_' only join parts.  The encoding is inferred from the other characters (hex, letters of one case, base32, base36, base62, base64),
which sets the alphabet of three tests of the hypothesis "uniformly random": chi-squared uniformity over the alphabet, the runs test on the upper half of the
alphabet, and lag-1 serial correlation.  Fisher's method combines the three p-values.  Random tokens have uniform p-values and natural ones (paths, words,
identifiers) crowd at 0, so for each encoding and length class the count above 0.5 tells how many are random, and the cut is the least one at which
the estimated share of natural tokens among the accepted is at most ``q``: false-discovery control that is strict for short tokens and lax for long ones.
A class with few tokens is pooled with its encoding, and that with all tokens and a fixed prior (``PRIOR`` tokens of weight each).

Nothing is shuffled but the histogram (encoding, length class, p-value bin), which is bounded whatever the input.  A text with many matches is
worked on in ``STEP`` matches at a time, so the work is near linear in its length.

Defined results: spans are half-open, in code points, of the whole match, ordered by start, then kind; null text counts as empty; repeated rows and ids are
scanned as the rows they are; an empty table gives none; columns of the input keep their values but for ``base`` and ``spans``, which ``secrets`` sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import table, tune

#: Fixed by the contract of the query; the groups of the first are the key and the value.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: A whole run; possessive, so it is read once.
ENCODED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BINS = 20
PRIOR = 40
#: Letters of one case alone say too little about a shorter token: compounds of some languages come near to uniform.
LETTERS = 24
STEP = 64
#: Noncharacters of Unicode, one of which stands for blanked characters: the first that the text has not.
MARKS = [chr(c) for c in range(0xFDD0, 0xFDE0)]
#: The patterns for a text with blanks, which may run on over them; with an earlier match blanked they cover all that they cover without.
_BLANKED = {"access": "AKIA[A-Z0-9{}]{16,}", "hex": "[0-9a-f{}]{24,}"}
_SPANS = "array<struct<s:int,e:int>>"


def _spans(matches: Column, gaps: Column) -> Column:
    """(s, e) of matches from the texts before them: running lengths, ``STEP`` at a time, so no long array is copied for each match."""
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    none, empty = F.expr(f"cast(array() as {_SPANS})"), F.expr(f"cast(array() as array<{_SPANS}>)")

    def one(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + x["m"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    def block(acc: Column, x: Column) -> Column:
        return F.transform(F.array(F.aggregate(x, F.struct(acc["at"].alias("at"), none.alias("out")), one)), lambda y: F.struct(y["at"].alias("at"), F.concat(acc["out"], F.array(y["out"])).alias("out")))[0]

    starts = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / STEP).cast("int"))
    blocks = F.transform(starts, lambda i: F.slice(lengths, i * STEP + 1, F.lit(STEP)))
    return F.when(F.size(matches) > 0, F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("out")), block)["out"])).otherwise(none)


def _matched(df: DataFrame, text: str, name: str, pattern: Column) -> DataFrame:
    """df with _{name}_m, the leftmost non-overlapping matches, and _{name}_g, the texts around them; both are empty without a match."""
    some, none = F.col(text).rlike(pattern) if isinstance(pattern, str) else F.regexp_like(text, pattern), F.expr("cast(array() as array<string>)")
    of = F.lit(pattern) if isinstance(pattern, str) else pattern
    df = df.withColumn(f"_{name}_m", F.when(some, F.regexp_extract_all(F.col(text), of, F.lit(0))).otherwise(none))
    return df.withColumn(f"_{name}_g", F.when(F.size(f"_{name}_m") > 0, F.split(F.col(text), of, -1)).otherwise(none))


def _blanked(text: str, name: str, mark: str, hit: Callable[[Column], Column] | None = None) -> Column:
    """The text with its matches (those that ``hit`` takes) as so many marks: pieces joined, so linear in the text."""
    m, g = F.col(f"_{name}_m"), F.col(f"_{name}_g")
    cover = lambda x: F.repeat(F.col(mark), F.length(x))
    pieces = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, x: F.concat(a, cover(x) if hit is None else F.when(hit(x), cover(x)).otherwise(x)))
    return F.when(F.size(m) > 0, F.concat(F.array_join(pieces, ""), F.element_at(g, -1))).otherwise(F.col(text))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _encoding(v: Column) -> Column:
    has = lambda p: v.rlike(p)
    return (
        F.when(has("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(has("^[a-z]+$"), "lower").when(has("^[A-Z]+$"), "upper").when(has("^[A-Z2-7]+$"), "base32").when(has("^([0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .when(has("^[0-9A-Za-z]+$"), "base62").otherwise("base64")
    )


def _with(value: Column, more: Callable[[Column], dict[str, Column]]) -> Column:
    """The struct with more fields; the struct is made once, however often the fields use it."""

    def add(x: Column) -> Column:
        out = x
        for name, field in more(x).items():
            out = out.withField(name, field)
        return out

    return F.transform(F.array(value), add)[0]


def _spelled(x: Column) -> dict[str, Column]:
    """The token in its encoding's spelling, and the alphabet."""
    enc, symbols = x["enc"], F.lit(None).cast("string")
    for name, alphabet in ALPHABETS.items():
        symbols = F.when(enc == name, alphabet).otherwise(symbols)
    return {"t": F.when(enc.isin("hex", "base36"), F.lower(x["body"])).otherwise(x["body"]), "abc": symbols}


def _listed(x: Column) -> dict[str, Column]:
    return {"n": F.length(x["t"]).cast("double"), "k": F.length(x["abc"]).cast("double"), "chars": F.filter(F.split(x["t"], ""), lambda c: c != "")}


def _coded(x: Column) -> dict[str, Column]:
    t = x["t"]
    squares = F.aggregate(F.array_distinct(x["chars"]), F.lit(0.0), lambda a, c: a + F.pow(F.length(t) - F.length(F.replace(t, c, F.lit(""))), F.lit(2)))
    return {"chi": x["k"] / x["n"] * squares - x["n"], "codes": F.transform(x["chars"], lambda c: (F.instr(x["abc"], c) - 1).cast("double"))}


def _summed(x: Column) -> dict[str, Column]:
    codes, last = x["codes"], F.size(x["codes"]) - 1
    return {
        "high": F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c >= x["k"] / 2).cast("double")), "mean": F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / x["n"],
        "pairs": F.arrays_zip(F.slice(codes, F.lit(1), last).alias("a"), F.slice(codes, F.lit(2), last).alias("b")),
    }


def _compared(x: Column) -> dict[str, Column]:
    half, mean, n, high = x["k"] / 2, x["mean"], x["n"], x["high"]
    return {
        "switches": F.aggregate(x["pairs"], F.lit(0.0), lambda a, c: a + ((c["a"] >= half) != (c["b"] >= half)).cast("double")),
        "lag": F.aggregate(x["pairs"], F.lit(0.0), lambda a, c: a + (c["a"] - mean) * (c["b"] - mean)),
        "spread": F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean)),
        "expect": 2 * high * (n - high) / n + 1,
    }


def _scored(x: Column) -> dict[str, Column]:
    """Normal deviates of the chi-squared, runs and serial-correlation tests; tokens that a test can't take fail it."""
    n, dof, expect = x["n"], x["k"] - 1, x["expect"]
    deviation = F.greatest((expect - 1) * (expect - 2) / (n - 1), F.lit(1e-9))
    return {
        "z_chi": (F.cbrt(x["chi"] / dof) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof)),
        "z_runs": F.when((x["high"] > 0) & (x["high"] < n), (x["switches"] + 1 - expect) / F.sqrt(deviation)).otherwise(F.lit(9.0)),
        "z_lag": F.when(x["spread"] > 0, (x["lag"] / x["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0)),
    }


def _combined(x: Column) -> dict[str, Column]:
    floor = lambda p: F.greatest(p, F.lit(1e-30))
    return {"y": -(F.ln(floor(_tail(x["z_chi"]))) + F.ln(floor(2 * _tail(F.abs(x["z_runs"])))) + F.ln(floor(2 * _tail(F.abs(x["z_lag"])))))}


def _battery(v: Column) -> Column:
    """Struct(enc, n, p) of one token: the combined p-value of the three tests; p is 0 for a token with hardly a character besides separators."""
    made = _with(F.struct(F.translate(v, "-_=", "").alias("body")), lambda x: {"enc": _encoding(x["body"])})
    for step in (_spelled, _listed, _coded, _summed, _compared, _scored, _combined):
        made = _with(made, step)
    p = lambda x: F.when(x["enc"].isin("lower", "upper") & (F.length(x["t"]) < LETTERS), 0.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.exp(-x["y"]) * (1 + x["y"] + x["y"] * x["y"] / 2)), F.lit(0.0)))
    short = F.length(F.translate(v, "-_=", "")) < 12
    tested = F.transform(F.array(made), lambda x: F.struct(x["enc"].alias("enc"), F.length(x["t"]).alias("n"), p(x).alias("p")))[0]
    return F.when(short, F.struct(F.lit("base64").alias("enc"), F.length(v).alias("n"), F.lit(0.0).alias("p"))).otherwise(tested)


def _class(enc: Column, n: Column) -> Column:
    """Encoding and length class (a quarter octave)."""
    return F.concat_ws(":", enc, F.floor(4 * F.log2(n.cast("double"))).cast("string"))


def cuts(histogram: list[tuple[str, int, int]], q: float) -> dict[str, float]:
    """For each class (encoding:length) the least p-value that is accepted; 1.1 where none is.

    Counts of a class are pooled with ``PRIOR`` tokens spread like its encoding's others, those with ``PRIOR`` spread like the other encodings', and those with a prior
    of half random and half natural tokens, so a class of any size has a cut and a large one is judged by its own counts.
    """
    grid = lambda: [0.0] * BINS
    every, by_enc, by_class = grid(), {}, {}
    for name, b, n in histogram:
        every[b] += n
        by_enc.setdefault(name.split(":")[0], grid())[b] += n
        by_class.setdefault(name, grid())[b] += n
    prior = [PRIOR / 2 / BINS + (PRIOR / 2 if b == 0 else 0) for b in range(BINS)]

    def pooled(own: list[float], wider: list[float]) -> list[float]:
        total = sum(wider)
        return [x + PRIOR * w / total for x, w in zip(own, wider)]

    less = lambda x, y: [i - j for i, j in zip(x, y)]
    out = {}
    for name, h in by_class.items():
        enc = by_enc[name.split(":")[0]]  # wider groups without the narrower one, so no token counts twice
        own = pooled(h, pooled(less(enc, h), pooled(less(every, enc), prior)))
        random = min(2 * sum(own[BINS // 2 :]), sum(own))
        out[name] = 1.1
        for b in range(BINS // 2 + 1):
            above = sum(own[b:])
            if max(0.0, above - (1 - b / BINS) * random) <= q * above:
                out[name] = b / BINS
                break
    return out


def secrets(docs: DataFrame, q: float = 0.1, masked: str | None = None) -> DataFrame:
    """docs with columns base (array of (s, kind, e)) and spans (with the random ones), both sorted.

    With ``masked``, the text is replaced too: every span, overlapping or touching ones as one, by that string.
    """
    spark = docs.sparkSession
    tune(spark)
    kind = lambda a, i: F.transform(a, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("kind"), x["e"].alias("e")))
    text = F.col("_text")
    free = F.coalesce(*(F.when(~F.contains(text, F.lit(m)), m) for m in MARKS), F.lit(MARKS[-1]))
    df = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text")).withColumn("_mark", free)
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        df = _matched(df, "_text", name, pattern).withColumn(f"_{name}", _spans(F.col(f"_{name}_m"), F.col(f"_{name}_g")))
    value = lambda x: F.length(F.regexp_extract(x, ASSIGN, 1)) >= 6
    long = F.zip_with("_assign", "_assign_m", lambda x, m: F.struct(x["s"].alias("s"), x["e"].alias("e"), value(m).alias("ok")))
    base = F.array_sort(F.concat(kind(F.filter(long, lambda x: x["ok"]), 0), kind(F.col("_access"), 1), kind(F.col("_hex"), 2)))
    df = df.withColumn("_base", base).withColumn("_blank", _blanked("_text", "assign", "_mark", value)).drop("_assign", "_assign_m", "_assign_g", "_access_m", "_access_g", "_hex_m", "_hex_g")
    for name, pattern in _BLANKED.items():
        df = _matched(df, "_blank", name, F.replace(F.lit(pattern), F.lit("{}"), F.col("_mark"))).withColumn("_blank", F.when(F.size(f"_{name}") > 0, _blanked("_blank", name, "_mark")).otherwise(F.col("_blank")))
    df = _matched(df, "_blank", "random", ENCODED).withColumn("_at", _spans(F.col("_random_m"), F.col("_random_g"))).withColumn("_tested", F.transform("_random_m", _battery))
    kept = ["_row", "_base", "_at", "_tested"] if masked is None else ["_row", "_base", "_at", "_tested", "_mark", "_blank", "_random_m", "_random_g"]
    scanned = table(df.select(*kept), "secrets-scanned")
    each = scanned.select(F.explode("_tested").alias("r")).select(_class(F.col("r.enc"), F.col("r.n")).alias("c"), F.least(F.lit(BINS - 1), F.floor(F.col("r.p") * BINS)).cast("int").alias("b"))
    limits = cuts([tuple(r) for r in each.groupBy("c", "b").count().collect()], q)
    limit = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)) if limits else F.expr("cast(map() as map<string,double>)")
    passes = lambda r: r["p"] >= F.coalesce(F.element_at(limit, _class(r["enc"], r["n"])), F.lit(2.0))
    judged = scanned.withColumn("_passed", F.transform("_tested", passes))
    random = F.filter(F.zip_with("_at", "_passed", lambda x, ok: F.struct(x["s"].alias("s"), x["e"].alias("e"), ok.alias("ok"))), lambda x: x["ok"])
    out = judged.withColumn("_spans", F.array_sort(F.concat("_base", kind(random, 3))))
    own = {c: F.col("_row")[c] for c in docs.columns if c not in ("base", "spans")}
    if masked is not None:
        pairs = F.zip_with(F.zip_with(F.slice("_random_g", F.lit(1), F.size("_random_m")), "_random_m", lambda g, m: F.struct(g.alias("g"), m.alias("m"))), "_passed", lambda x, ok: F.concat(x["g"], F.when(ok, F.repeat("_mark", F.length(x["m"]))).otherwise(x["m"])))
        whole = F.when(F.size("_random_m") > 0, F.concat(F.array_join(pairs, ""), F.element_at("_random_g", -1))).otherwise(F.col("_blank"))
        own["text"] = F.when(F.size("_spans") > 0, F.regexp_replace(whole, F.concat(F.col("_mark"), F.lit("+")), F.lit(masked))).otherwise(own["text"])
    return out.select(*(c.alias(n) for n, c in own.items()), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def _written(spans: str) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_scan(docs: DataFrame, **options) -> DataFrame:
    """The registered query: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    count = lambda a, i: F.size(F.filter(a, lambda x: x["kind"] == i)).cast("long")
    out = secrets(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", *(count("base", i).alias(f"n_{KINDS[i]}") for i in range(3)), F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"), count("spans", 3).alias("n_random"))

