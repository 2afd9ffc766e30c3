"""Scalar text functions: padding, elapsed time, number formats, patterns of joins and sub-clusters, and line parsers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F


def left_pad(x: Column, width: int) -> Column:
    """Blank-padded on the left; longer numbers are not cut."""
    return F.format_string(f"%{width}d", x.cast("long"))


def right_pad(x: Column, width: int) -> Column:
    return F.format_string(f"%-{width}d", x.cast("long"))


def elapsed(ms: Column) -> Column:
    """Days, hours, minutes, seconds and milliseconds."""
    part = lambda div, mod: (F.floor(ms / div) % mod if mod else F.floor(ms / div)).cast("long")
    return F.format_string("%dd:%02dH:%02dM:%02dS:%03dmS", part(86_400_000, 0), part(3_600_000, 24), part(60_000, 60), part(1_000, 60), (ms % 1000).cast("long"))


def _printed(x: Column, pattern: str) -> Column:
    """C's printf of a double: the exact binary value rounded, ties to even; the JVM's formatter rounds ties of the shortest decimal up."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            # a null arrives as NaN beside true NaNs, and is made null again outside
            yield pd.Series([pattern % v for v in b.astype("float64")], dtype="object")

    return F.when(x.isNotNull(), F.pandas_udf(run, "string")(x.cast("double")))


def fixed(x: Column, digits: int) -> Column:
    return _printed(x, f"%.{digits}f")


def scientific(x: Column, digits: int) -> Column:
    return _printed(x, f"%.{digits}E")


def round_up(x: Column, digits: int = 4) -> Column:
    return F.ceil(x * 10.0**digits) / 10.0**digits


def label_line(line: Column) -> Column:
    """struct(idx, name, length) of 'idx [words of a name] length'; null for blank lines."""
    t = F.split(F.trim(line), "[\t ]")
    n = F.size(t)
    name = F.when(n > 2, F.array_join(F.slice(t, F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).otherwise("")
    return F.when(F.trim(line) != "", F.struct(t[0].cast("int").alias("idx"), name.alias("name"), F.element_at(t, -1).cast("int").alias("length")))


def cluster_line(line: Column) -> Column:
    """struct(idx, cluster): the second of two tokens, the fifth of more."""
    t = F.split(F.trim(line), "\\s+")
    return F.struct(t[0].cast("int").alias("idx"), F.when(F.size(t) > 2, F.get(t, F.lit(4))).otherwise(F.get(t, F.lit(1))).cast("int").alias("cluster"))


def plot_cluster(line: Column) -> Column:
    """Cluster of a plot line: of 2 or 5 tokens, else 0."""
    t = F.filter(F.split(F.trim(line), "[\t ]"), lambda x: x != "")
    return F.when(F.size(t) == 2, F.get(t, F.lit(1)).cast("int")).when(F.size(t) == 5, F.get(t, F.lit(4)).cast("int")).otherwise(0)


def center_line(line: Column) -> Column:
    """struct(idx, measure, count, source, method, cluster, name, length) of a center file's line; a name may have several words."""

    def part(key: str, kind: str, pattern: str = r"(\S+)") -> Column:
        found = F.regexp_extract(line, f"(?:^|\\s){key}={pattern}", 1)
        return F.when(found != "", found).cast(kind)

    name = part("Sequence", "string", r"(.*?)(?=\s+Length=|\s*$)")
    return F.struct(part("PointNumber", "int", r"\s*(\d+)").alias("idx"), part("Measure", "double").alias("measure"), part("Count", "double").alias("count"), part("Source", "string").alias("source"), part("Method", "string").alias("method"), part("Group", "int").alias("cluster"), name.alias("name"), part("Length", "int").alias("length"))


def skip_ranks(pattern: str) -> list[int]:
    """'a,b,c' as sorted distinct numbers."""
    return sorted({int(x) for x in pattern.split(",") if x.strip()})


def join_pattern(pattern: Column) -> Column:
    """Array of struct(main, other) of 'a+b|c+d+e|'."""
    groups = F.filter(F.split(pattern, "\\|"), lambda x: x != "")

    def pairs(g: Column) -> Column:
        ids = F.transform(F.split(g, "\\+"), lambda x: x.cast("int"))
        return F.transform(F.slice(ids, F.lit(2), F.size(ids) - 1), lambda o: F.struct(ids[0].alias("main"), o.alias("other")))

    return F.flatten(F.transform(groups, pairs))


def subcluster_pattern(pattern: Column) -> Column:
    """Array of struct(cluster, suggested, actual) of 'c,s,a|c,s,a|'."""
    groups = F.filter(F.split(pattern, "\\|"), lambda x: x != "")

    def one(g: Column) -> Column:
        t = F.transform(F.split(g, ","), lambda x: x.cast("int"))
        return F.struct(t[0].alias("cluster"), t[1].alias("suggested"), t[2].alias("actual"))

    return F.transform(groups, one)


def fill(pattern: Column, **values: Column) -> Column:
    """Replaces {0}, {1}, {2} given as _0, _1, _2."""
    for k, v in values.items():
        pattern = F.replace(pattern, F.lit("{" + k.lstrip("_") + "}"), v.cast("string"))
    return pattern


def parse_joins(pattern: str) -> dict[int, int]:
    """The same on the driver: other -> main, for tool arguments."""
    out = {}
    for group in filter(None, pattern.split("|")):
        main, *others = (int(x) for x in group.split("+"))
        out |= {o: main for o in others}
    return out
