"""From raw documents to packed training sequences: quality, near-dedup, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return the columns of
``documents``; ``run`` hands a stage's rows to the next as a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from frostline.llm.common import documents, table, tune
from frostline.llm.decontaminate import contaminated
from frostline.llm.near_dedup import near_dedup
from frostline.llm.packing import pack
from frostline.llm.quality_classifier import score, train
from frostline.llm.secret_scan import secrets

#: Ids up to this many are broadcast to drop their rows; more are joined by shuffling.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """docs without the rows of keys; rows with a null among them stay."""
    keys = table(keys.distinct(), "dropped-ids")
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, names, "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labels, scores under 0.5."""
    tune(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("text", F.struct(*docs.columns).alias("_document")), model)
    return out.where("quality_score >= 0.5").select("_document.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id (of rows that repeat it, the one with the least text hash).

    Rows that repeat an id with texts that are no near copies all stay; so do rows with a null id, which link with nothing.  Shingles have
    five words here; the four of ``op1_near_dedup`` are that query's own."""
    found = table(near_dedup(docs, shingle_words=5).where("component is not null").select("doc_id", "text_hash", "first"), "near-copies")
    keyed = docs.select(F.struct(*docs.columns).alias("_document"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text_hash"))
    key = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash")]
    left = _without(keyed, found.where("not first").select(*key), ["_id", "_text_hash"])
    again = found.where("first").groupBy("doc_id", "text_hash").count().where("count > 1").select(*key)
    if again.limit(1).count():
        once = left.join(again, ["_id", "_text_hash"], "left_semi").dropDuplicates(["_id", "_text_hash"])
        left = _without(left, again, ["_id", "_text_hash"]).unionByName(once)
    return left.select("_document.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or an edited copy of one."""
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, hits.select("doc_id"), ["doc_id"]).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; every secret found is replaced in the text, and n_chars of those texts follows.  Other columns, whatever their names, are untouched."""
    names = docs.columns
    packed = docs.select("text", F.struct(*names).alias("_document"))
    out = secrets(packed, masked="[SECRET]")
    new = {c: F.col("_document")[c] for c in names} | {"text": F.col("text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(new["n_chars"])
    return out.select(*(new[c].alias(c) for c in names))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every token of every document in bins of the permitted lengths."""
    return pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: Not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
