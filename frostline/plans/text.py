"""Queries of the text functions and line parsers, on lines made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from .registry import query


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


LINE = "CASE doc_id % 4 WHEN 0 THEN doc_id || chr(9) || n_chars WHEN 1 THEN doc_id || ' ' || source || ' ' || n_chars WHEN 2 THEN doc_id || ' ' || source || ' ' || lang || ' ' || n_chars ELSE '' END"


@query("q80_label_parse", f"WITH l AS (SELECT doc_id, {LINE} AS line FROM documents), s AS (SELECT doc_id, string_split_regex(trim(line), '[\t ]') AS t FROM l WHERE line <> '') SELECT doc_id, CAST(t[1] AS INTEGER) AS idx, CASE WHEN len(t) > 2 THEN array_to_string(t[2:len(t) - 1], ' ') ELSE '' END AS name, CAST(t[-1] AS INTEGER) AS length FROM s")
def _(spark, sf):
    d = _docs(spark, sf)
    k, n = F.col("doc_id") % 4, F.col("n_chars").cast("string")
    i = F.col("doc_id").cast("string")
    line = F.when(k == 0, F.concat_ws("\t", i, n)).when(k == 1, F.concat_ws(" ", i, "source", n)).when(k == 2, F.concat_ws(" ", i, "source", "lang", n)).otherwise("")
    return d.select("doc_id", x.label_line(line).alias("l")).where("l is not null").select("doc_id", "l.idx", "l.name", "l.length")


@query("q81_pad_format", "SELECT doc_id, printf('%6d', doc_id * 997) AS l, printf('%-6d', doc_id * 997) AS r, printf('%.3f', n_chars / 7e0) AS f, printf('%.2E', n_chars / 7e0) AS e FROM documents")
def _(spark, sf):
    v = F.col("n_chars") / 7.0
    return _docs(spark, sf).select("doc_id", x.left_pad(F.col("doc_id") * 997, 6).alias("l"), x.right_pad(F.col("doc_id") * 997, 6).alias("r"), x.fixed(v, 3).alias("f"), x.scientific(v, 2).alias("e"))


@query("q82_elapsed_format", "SELECT doc_id, printf('%dd:%02dH:%02dM:%02dS:%03dmS', ms // 86400000, ms // 3600000 % 24, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS took FROM (SELECT doc_id, n_chars * 12345 + doc_id AS ms FROM documents)")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", x.elapsed(F.col("n_chars") * 12345 + F.col("doc_id")).alias("took"))


@query("q83_join_pattern", "WITH g AS (SELECT label, unnest(list_filter(string_split(label || '+' || (label + 2) || '|' || (label + 4) || '+' || (label + 5) || '+' || (label + 7) || '|', '|'), lambda s: s <> '')) AS g FROM (SELECT DISTINCT label FROM embeddings)), s AS (SELECT label, string_split(g, '+') AS t FROM g) SELECT label, CAST(t[1] AS INTEGER) AS main, CAST(unnest(t[2:]) AS INTEGER) AS other FROM s")
def _(spark, sf):
    b = spark.read.parquet(f"{sf}/embeddings.parquet").select("label").distinct()
    n = lambda k: (F.col("label") + k).cast("string")
    pattern = F.concat(n(0), F.lit("+"), n(2), F.lit("|"), n(4), F.lit("+"), n(5), F.lit("+"), n(7), F.lit("|"))
    return b.select("label", F.explode(x.join_pattern(pattern)).alias("p")).select("label", "p.main", "p.other")


@query("q84_cluster_number_parse", "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS INTEGER) AS idx, CAST(l_suppkey AS INTEGER) AS cluster, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS INTEGER) ELSE CAST(l_suppkey AS INTEGER) END AS plotted FROM lineitem")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/lineitem.parquet")
    part = [F.col(c).cast("string") for c in ("l_partkey", "l_quantity", "l_discount", "l_tax", "l_suppkey")]
    line = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws("\t", part[0], part[4])).otherwise(F.concat_ws(" ", *part))
    out = d.select("l_orderkey", "l_linenumber", x.cluster_line(line).alias("l"), x.plot_cluster(line).alias("plotted"))
    return out.select("l_orderkey", "l_linenumber", "l.idx", "l.cluster", "plotted")


@query("q89_subcluster_parse", "WITH g AS (SELECT label, unnest(list_filter(string_split(label || ',3,2|' || (label + 1) || ',4,4|', '|'), lambda s: s <> '')) AS g FROM (SELECT DISTINCT label FROM embeddings)), s AS (SELECT label, string_split(g, ',') AS t FROM g) SELECT label, CAST(t[1] AS INTEGER) AS cluster, CAST(t[2] AS INTEGER) AS suggested, CAST(t[3] AS INTEGER) AS actual FROM s")
def _(spark, sf):
    b = spark.read.parquet(f"{sf}/embeddings.parquet").select("label").distinct()
    pattern = F.concat(F.col("label").cast("string"), F.lit(",3,2|"), (F.col("label") + 1).cast("string"), F.lit(",4,4|"))
    return b.select("label", F.explode(x.subcluster_pattern(pattern)).alias("p")).select("label", "p.cluster", "p.suggested", "p.actual")


@query("q90_center_line_parse", "SELECT doc_id, CAST(doc_id AS INTEGER) AS idx, n_chars / 8e0 AS measure, source AS method, CAST(doc_id % 10 AS INTEGER) AS cluster FROM documents")
def _(spark, sf):
    d = _docs(spark, sf)
    line = F.format_string("PointNumber=%-6d Measure=%.6f Method=%s Group=%d", "doc_id", F.col("n_chars") / 8.0, "source", F.col("doc_id") % 10)
    return d.select("doc_id", x.center_line(line).alias("l")).select("doc_id", "l.idx", "l.measure", "l.method", "l.cluster")


@query("q91_fill_pattern", "SELECT doc_id, 'block_' || source || '_' || lang || '.bin' AS name FROM documents")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", x.fill(F.lit("block_{1}_{2}.bin"), _1=F.col("source"), _2=F.col("lang")).alias("name"))
