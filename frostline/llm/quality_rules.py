"""Quality rules: robust multivariate outliers by minimum-covariance-determinant (MCD) estimates.

Each document becomes a vector of transformed statistics.  Per (language, source) the estimator takes three deterministic starts (medians and MADs; the
mean and covariance of all rows; those of rows clipped to two MADs) through concentration steps: keep the ``support`` share of rows nearest to the
centre, take their mean and covariance, repeat.  After ``TRIALS`` steps the start with the least determinant goes on until its determinant falls no further:
a step never raises it but by the rounding to bins, so each group keeps its least one, and only groups that still fall take another step.
A step is one aggregation by (group, start, distance bin): every bin carries its count, sums and products, so the nearest rows are whole bins
taken by a running count.  No group is gathered in a task: a hot source only adds to the same few hundred bins.  The subset thus ends at a bin edge (1/16
octave of distance).

Groups with under ``min_group`` rows use the estimate of their language, made from all its rows, and languages under it that of all rows.  Covariances are
scaled to be consistent with the support, and each variance is at least the square of ``SHARE`` of the group's own MAD or of ``FLOOR``, since statistics such
as symbols per word are constant on clean text.

Defined results: null text counts as empty (0 words, base_failed, not kept); null lang or source is a group of its own name ''; repeated rows and ids are
the rows they are; rows at equal distance are in the support together; a text of any length is one vector; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textkernel as tk
from .common import table, tune

STATS = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "other_share")
P = len(STATS)
#: Least standard deviation of each transformed statistic, for groups without spread, and the least share of a group's scaled MAD.
FLOOR = (0.5, 0.03, 0.05, 0.15, 0.15, 0.03, 0.03, 0.03)
SHARE = 0.8
TRIALS = 2
#: Added to denominators, so shares of very short texts shrink towards 0.
SHORT_CHARS = 200
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_LETTER = np.isin(np.arange(256), np.r_[65:91, 97:123, 128:256])


def repeated(key: np.ndarray) -> np.ndarray:
    """Whether each entry's value is there more than once."""
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _by_doc(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return s[off[1:]] - s[off[:-1]]


def _salted(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return tk.mix(h + (doc.astype(np.uint64) + tk.U(1)) * tk.U(0x9E3779B97F4A7C15))


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in tk.slices(batch):
            yield _statistics(b)


def _statistics(b: pa.RecordBatch) -> pa.RecordBatch:
    w = tk.words(b.column("text"))
    data, off, n = w.data, w.offset, w.n
    head = (data & 0xC0) != 0x80
    sep = tk._SEP[data]
    n_words = np.diff(w.first)
    word_chars = _by_doc(head & ~sep, off)
    n_symbols = _by_doc(_SYMBOL[data], off)
    # lines: from a document's start or behind a newline up to the next newline or its end
    nl = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([off[:-1], nl + 1])), np.sort(np.concatenate([nl, off[1:]]))
    line_doc = np.repeat(np.arange(n), _by_doc(data == 10, off) + 1)
    filled = np.concatenate([[0], np.cumsum(~sep, dtype=np.int64)])
    has = filled[end] > filled[start]
    p, inv = tk._powers(tk._BASE, len(data) + 1)
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk._VALUE[data] * p[: len(data)])])
    line = (s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64)
    key, line_doc = _salted(line[has], line_doc[has]), line_doc[has]
    distinct = np.unique(key, return_index=True)[1]
    n_lines = np.bincount(line_doc, minlength=n)
    n_dup_lines = n_lines - np.bincount(line_doc[distinct], minlength=n)
    # words covered by a 5-word window that the text has at least twice
    at, h = tk.windows(w, 5)
    at = at[repeated(_salted(h, w.doc[at]))]
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    n_repeat = w.sums(np.cumsum(cover)[:-1] > 0)

    chars, some = word_chars + SHORT_CHARS, n_words + SHORT_CHARS // 5  # one number in a ten-word text is no outlier
    letters = _by_doc(_LETTER[data] & head, off)
    vec = (
        np.log1p(n_words), np.log((word_chars + SHORT_CHARS) / (n_words + SHORT_CHARS / 5)), np.sqrt(n_symbols / chars), np.sqrt(n_dup_lines / np.maximum(n_lines, 1)), np.sqrt(n_repeat / some),
        _by_doc(_UPPER[data], off) / chars, _by_doc(_DIGIT[data], off) / chars, (word_chars - letters) / chars,
    )
    base = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)
    arrays = [b.column(0), b.column(1), b.column(2), *(pa.array(x.astype(np.int64)) for x in base), *(pa.array(x.astype(np.float64)) for x in vec)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "source", *BASE, *STATS])


def _bin(d2: Column) -> Column:
    return F.least(F.lit(1023), F.floor(16 * F.log2(1 + d2))).cast("int")


def _distance(x: list[Column], centre: Column, white: Column) -> Column:
    """Squared Mahalanobis distance; white is the inverse Cholesky factor, row by row."""
    z = [xi - centre[i] for i, xi in enumerate(x)]
    total = F.lit(0.0)
    for i in range(P):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + white[i * P + j] * z[j]
        total = total + row * row
    return total


def _fit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean, whitening and log determinant of each group and start from its summed count, sums, products, floors and consistency factor."""
    for b in rows:
        out: list[list] = [[], [], [], [], []]
        for r in b.to_pylist():
            mean, cov = fitted(max(r["n"], 1), np.array([r[f"s{i}"] for i in range(P)]), {(i, j): r[f"q{i}_{j}"] for i in range(P) for j in range(i + 1)}, r["factor"], np.array(r["floor"]))
            white = np.linalg.inv(np.linalg.cholesky(cov))
            for values, x in zip(out, (r["key"], r["start"], mean.tolist(), white.ravel().tolist(), float(np.linalg.slogdet(cov)[1]))):
                values.append(x)
        kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["key", "start", "centre", "white", "logdet"])


def fitted(n: int, sums: np.ndarray, products: dict[tuple[int, int], float], factor: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, cov = sums / n, np.zeros((P, P))
    for (i, j), q in products.items():
        cov[i, j] = cov[j, i] = factor * (q / n - mean[i] * mean[j])
    return mean, cov + np.diag(np.maximum(np.square(floor) - np.diag(cov), 0) + 1e-9)


def consistency(support: float) -> float:
    """Factor by which the covariance of the nearest ``support`` of normal rows is too small (Wilson-Hilferty)."""
    normal = NormalDist()
    q = chi2_quantile(normal.inv_cdf(support)) if support < 1 else np.inf
    p = P + 2
    return support / normal.cdf(((q / p) ** (1 / 3) - (1 - 2 / (9 * p))) / (2 / (9 * p)) ** 0.5) if support < 1 else 1.0


def chi2_quantile(z: float, p: int = P) -> float:
    """Wilson-Hilferty: the chi-squared quantile at the normal quantile z."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def mcd_outliers(docs: DataFrame, support: float = 0.75, steps: int = 12, z_cut: float = 3.09, min_group: int = 60, broadcast_groups: int = 20_000, settled: float = 0.01) -> DataFrame:
    """doc_id, lang, source, base statistics, STATS, group key, distance2 (rescaled) and outlier of each row of docs(doc_id, text, lang, source).

    The number of groups is counted, and the table of estimates broadcast only up to ``broadcast_groups``; beyond, it is an ordinary join.
    A group's steps end when its log determinant falls by less than ``settled``, or after ``steps``.
    """
    spark = docs.sparkSession
    tune(spark)
    cols = docs.select("doc_id", "lang", "source", "text")
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in STATS)
    stats = table(cols.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(statistics, schema), "mcd-stats")
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    keys = table(_groups(stats.groupBy(lang.alias("l"), source.alias("s")).count(), min_group), "mcd-keys")
    small = keys.count() <= broadcast_groups

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    grouped = stats.join(side(keys), (lang == F.col("l")) & (source == F.col("s"))).drop("l", "s")
    # a row counts in every estimate that it belongs to, and is judged by one
    rows, judged = grouped.select(F.explode("fits").alias("key"), *STATS), grouped.drop("fits")
    x = [F.col(c) for c in STATS]
    medians = rows.groupBy("key").agg(F.array(*(F.percentile_approx(c, 0.5, 1000) for c in x)).alias("median"))
    spread = rows.join(side(medians), "key").groupBy("key").agg(F.first("median").alias("median"), F.array(*(1.4826 * F.percentile_approx(F.abs(c - F.col("median")[i]), 0.5, 1000) for i, c in enumerate(x))).alias("mad"))
    scales = table(spread.withColumn("floor", F.array(*(F.greatest(F.lit(FLOOR[i]), SHARE * F.col("mad")[i]) for i in range(P)))), "mcd-scales")
    fit_schema = "key string, start int, centre array<double>, white array<double>, logdet double"
    names = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}_{j}" for i in range(P) for j in range(i + 1))]

    def sums(v: list[Column]) -> list[Column]:
        return [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(v)), *(F.sum(v[i] * v[j]).alias(f"q{i}_{j}") for i in range(P) for j in range(i + 1))]

    def estimates(summed: DataFrame, factor: float, name: str) -> DataFrame:
        return table(summed.join(side(scales.select("key", "floor")), "key").withColumn("factor", F.lit(factor)).mapInArrow(_fit, fit_schema), name)

    near = [F.col("median")[i] + F.least(F.greatest(c - F.col("median")[i], -2 * F.col("floor")[i]), 2 * F.col("floor")[i]) for i, c in enumerate(x)]
    plain = estimates(rows.groupBy("key").agg(*sums(x)).withColumn("start", F.lit(1)), 1.0, "mcd-all")
    clipped = estimates(rows.join(side(scales), "key").groupBy("key").agg(*sums(near)).withColumn("start", F.lit(2)), 1.0, "mcd-clipped")
    diagonal = scales.select("key", F.lit(0).alias("start"), F.col("median").alias("centre"), F.array(*(1 / F.col("floor")[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P))).alias("white"), F.lit(0.0).alias("logdet"))
    est = diagonal.unionByName(plain).unionByName(clipped)
    whole, running, factor = Window.partitionBy("key", "start"), Window.partitionBy("key", "start").orderBy("bin"), consistency(support)
    finished = None
    for step in range(1, steps + 1):
        far = rows.join(side(est), "key").withColumn("bin", _bin(_distance(x, F.col("centre"), F.col("white"))))
        bins = far.groupBy("key", "start", "bin").agg(*sums(x))
        kept = bins.withColumn("before", F.sum("n").over(running) - F.col("n")).withColumn("all", F.sum("n").over(whole)).where(F.col("before") < support * F.col("all"))
        new = estimates(kept.groupBy("key", "start").agg(*(F.sum(c).alias(c) for c in names)), factor, "mcd-step")
        if step == TRIALS:
            best = new.groupBy("key").agg(F.min(F.struct("logdet", "start"))["start"].alias("start"))
            est = table(new.join(side(best), ["key", "start"]), "mcd-best")
        elif step > TRIALS:
            both = new.join(side(est.select("key", F.struct("start", "centre", "white", "logdet").alias("was"))), "key")
            now, falls = F.struct("start", "centre", "white", "logdet"), F.col("logdet") <= F.col("was.logdet") - settled
            kept = both.select("key", F.when(F.col("logdet") < F.col("was.logdet"), now).otherwise(F.col("was")).alias("e"), falls.alias("falls"))
            kept = table(kept.select("key", "e.*", "falls"), "mcd-least")
            est = kept.where("falls").drop("falls")
            finished = kept.where("not falls").drop("falls") if finished is None else finished.unionByName(kept.where("not falls").drop("falls"))
            if est.limit(1).count() == 0:
                break
        else:
            est = new
    est = est if finished is None else est.unionByName(finished)
    far = judged.join(side(est.drop("start", "logdet")), "key").withColumn("d2", _distance(x, F.col("centre"), F.col("white"))).drop("centre", "white")
    # of the rows that made the estimate, not only of those it judges
    made = rows.join(side(est.drop("start", "logdet")), "key")
    middle = made.groupBy("key").agg(F.percentile_approx(_distance(x, F.col("centre"), F.col("white")), 0.5, 1000).alias("mid"))
    unit = chi2_quantile(0.0)
    # floors make distances shrink, never grow: the median is only ever scaled down to its nominal value
    scaled = F.col("d2") * F.least(F.lit(1.0), F.lit(unit) / F.greatest(F.col("mid"), F.lit(1e-9)))
    out = far.join(side(middle), "key").withColumn("distance2", scaled).drop("d2", "mid")
    return out.withColumn("outlier", F.col("distance2") > chi2_quantile(z_cut))


def _groups(pairs: DataFrame, least: int) -> DataFrame:
    """(l, s, key, fits) of (l, s, count): the estimate that judges a pair, and the estimates that its rows belong to, of those that judge any."""
    own, of_lang, every = F.concat_ws("\x01", F.lit("ls"), "l", "s"), F.concat_ws("\x01", F.lit("l"), "l"), F.lit("all")
    by_lang = Window.partitionBy("l")
    key = F.when(F.col("count") >= least, own).when(F.sum("count").over(by_lang) >= least, of_lang).otherwise(every)
    keyed = pairs.withColumn("key", key)
    used = keyed.where(F.col("key") == every).limit(1).count() > 0
    needed = F.max((F.col("key") == of_lang).cast("int")).over(by_lang) == 1
    fits = F.array(F.when(F.col("key") == own, own), F.when(needed, of_lang), every if used else F.lit(None))
    return keyed.select("l", "s", "key", F.filter(fits, lambda f: f.isNotNull()).alias("fits"))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """The registered query's columns: base counts, base_failed, kept, and the distance behind the verdict."""
    out = mcd_outliers(docs, **options)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & ~F.col("outlier")).alias("kept"), F.round("distance2", 6).alias("distance2"))
