"""Queries of the reductions, each per group on events or line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import reductions as r
from .registry import query

VEC = "[l_quantity, l_discount, l_tax]"


def _lines(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def _vector():
    return F.array("l_quantity", "l_discount", "l_tax")


@query("q30_bool_or", "SELECT event_type, bool_or(value > 400) AS any_large, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(r.bool_or(F.col("value") > 400).alias("any_large"), F.count(F.lit(1)).alias("n"))


@query("q31_int_sum", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, count(l_linenumber) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    n, s = r.count_and_sum(F.col("l_linenumber"))
    return _lines(spark, sf).groupBy("l_returnflag").agg(s.alias("s"), n.alias("n"))


@query("q32_histogram", "SELECT event_type, CAST(floor(value / 10) AS INTEGER) AS bin, count(*) AS n FROM events WHERE floor(value / 10) BETWEEN 0 AND 19 GROUP BY ALL")
def _(spark, sf):
    return r.histogram(_events(spark, sf), F.floor(F.col("value") / 10), 20, ["event_type"])


@query("q33_floored_max", "SELECT event_type, greatest(0, max(50 - value)) AS top FROM events GROUP BY event_type")
def _(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(r.floored_max(50 - F.col("value")).alias("top"))


@query("q34_mean_sigma", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sigma FROM events GROUP BY event_type")
def _(spark, sf):
    n, mean, sigma = r.mean_sigma(F.col("value"))
    return _events(spark, sf).groupBy("event_type").agg(n.alias("n"), F.round(mean, 6).alias("mean"), F.round(sigma, 6).alias("sigma"))


@query("q35_double_sum", "SELECT l_linestatus, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_linestatus")
def _(spark, sf):
    return _lines(spark, sf).groupBy("l_linestatus").agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))


@query("q36_double_mean", "SELECT l_linestatus, round(avg(l_discount), 6) AS mean, 0.0 AS none FROM lineitem GROUP BY l_linestatus")
def _(spark, sf):
    return _lines(spark, sf).groupBy("l_linestatus").agg(F.round(r.mean_or_zero(F.col("l_discount")), 6).alias("mean"), r.mean_or_zero(F.lit(None).cast("double")).alias("none"))


def _element_sql(expr: str) -> str:
    return f"WITH x AS (SELECT l_returnflag, unnest([0, 1, 2]) AS pos, unnest({VEC}) AS value FROM lineitem) SELECT l_returnflag, pos, {expr} AS value FROM x GROUP BY ALL"


@query("q37_vector_int_sum", "WITH x AS (SELECT l_returnflag, unnest([0, 1]) AS pos, unnest([CAST(l_linenumber AS BIGINT), l_orderkey % 10]) AS value FROM lineitem) SELECT l_returnflag, pos, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY ALL")
def _(spark, sf):
    return r.element_sum(_lines(spark, sf), F.array(F.col("l_linenumber").cast("long"), F.col("l_orderkey") % 10), ["l_returnflag"])


@query("q38_vector_double_max", _element_sql("greatest(-1e10, max(value))"))
def _(spark, sf):
    return r.element_max(_lines(spark, sf), _vector(), ["l_returnflag"])


@query("q39_vector_double_sum", _element_sql("round(sum(value), 4)"))
def _(spark, sf):
    return r.element_sum(_lines(spark, sf), _vector(), ["l_returnflag"]).withColumn("value", F.round("value", 4))


@query("q40_matrix_row_sum", f"WITH x AS (SELECT l_linenumber AS row, unnest([0, 1, 2]) AS pos, unnest({VEC}) AS value FROM lineitem) SELECT row, pos, round(sum(value), 4) AS value FROM x GROUP BY ALL")
def _(spark, sf):
    return r.element_sum(_lines(spark, sf).withColumn("row", F.col("l_linenumber")), _vector(), ["row"]).withColumn("value", F.round("value", 4))


@query("q41_scatter_add", "WITH x AS (SELECT l_returnflag, unnest([l_orderkey % 5, l_partkey % 5]) AS location, unnest([l_quantity, l_tax]) AS value FROM lineitem) SELECT l_returnflag, location, round(sum(value), 4) AS value FROM x GROUP BY ALL")
def _(spark, sf):
    out = r.scatter_add(_lines(spark, sf), F.array(F.col("l_orderkey") % 5, F.col("l_partkey") % 5), F.array("l_quantity", "l_tax"), ["l_returnflag"])
    return out.withColumn("value", F.round("value", 4))


@query("q42_array_mean", _element_sql("round(avg(value), 6)"))
def _(spark, sf):
    return r.element_mean(_lines(spark, sf), _vector(), ["l_returnflag"]).withColumn("value", F.round("value", 6))


@query("q43_argmin_argmax", "SELECT l_returnflag, min(l_quantity) AS lo, min(l_orderkey) FILTER (l_quantity = lo_v) AS lo_first, max(l_quantity) AS hi, max(l_orderkey) FILTER (l_quantity = hi_v) AS hi_last FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_returnflag) AS lo_v, max(l_quantity) OVER (PARTITION BY l_returnflag) AS hi_v FROM lineitem) GROUP BY l_returnflag")
def _(spark, sf):
    g = _lines(spark, sf).groupBy("l_returnflag").agg(r.argmin_first(F.col("l_quantity"), F.col("l_orderkey")).alias("a"), r.argmax_last(F.col("l_quantity"), F.col("l_orderkey")).alias("b"))
    return g.select("l_returnflag", F.col("a.v").alias("lo"), F.col("a.i").alias("lo_first"), F.col("b.v").alias("hi"), F.col("b.i").alias("hi_last"))


@query("q44_k_smallest", "SELECT event_type, event_id, value, CAST(rank AS INTEGER) AS rank FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank FROM events) WHERE rank <= 8")
def _(spark, sf):
    return r.k_smallest(_events(spark, sf).select("event_type", "event_id", "value"), ["event_type"], "value", "event_id", 8)


@query("q45_occupation", "SELECT label AS cluster, count(*) AS n, list(vec_id ORDER BY vec_id)[1:5] AS first_points FROM embeddings GROUP BY label")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    first = r.k_smallest(e.select(F.col("label").alias("cluster"), "vec_id", F.lit(0).alias("zero")), ["cluster"], "zero", "vec_id", 5)
    some = first.groupBy("cluster").agg(F.sort_array(F.collect_list("vec_id")).alias("first_points"))
    return e.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n")).join(some, "cluster")


@query("q46_label_width", "SELECT CAST(max(length(source)) AS BIGINT) AS width, count(DISTINCT lang) AS kinds FROM documents")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").agg(F.max(F.length("source")).cast("long").alias("width"), F.countDistinct("lang").alias("kinds"))


@query("q47_round_up", "SELECT l_orderkey, l_linenumber, ceil(l_discount * l_tax * 1e4) / 1e4 AS up FROM lineitem")
def _(spark, sf):
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", text.round_up(F.col("l_discount") * F.col("l_tax")).alias("up"))
