"""Deterministic sharded WARC writer and its reader.

Records are range-partitioned by page_id and sorted inside a shard.  The cuts are exact byte quantiles: sizes are summed by page_id and then along the
sorted ids, so a shard holds about ``shard_bytes`` however the ids are spread.  The ids' first shards, one number a shard (13 MB for 100 TB), are
all that the driver gets and tasks are sent.  An id with the bytes of several shards is dealt over them by digest and URL.
A task streams its shards: every record is one gzip member with regenerated headers and digests, and a file is rolled
when its compressed size reaches ``roll_bytes``.  A file is written under a temporary name with the attempt in it and renamed when closed; names
depend on shard and number only and contents on the rows only, so a repeated task puts the same bytes at the same place.  The
manifest (file, records, bytes, SHA-256) is written last by Spark; the reader takes only files that a manifest with its success marker
names, and checks their SHA-256.

Of records with equal payloads of ``least`` bytes or more, the one with the smallest page_id is a response and the others revisit it.

The reader refuses a folder without the manifest's success marker and a file that differs from it, and reads members in bounded chunks.

Defined results: null html is an empty payload; null url is written as about:blank; rows with a null page_id are responses, and of repeated
page_ids with the same payload each is a response if it has the smallest id; an empty table gives a manifest without files.  Ids may be any
64-bit integers; a payload of any length is one record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import exists, shared_dir, table, tune

_CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
_MANIFEST = "file string, shard int, number int, records long, bytes long, sha256 string, first_page long, last_page long"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}|{digest}'.encode()).hexdigest()[:32])}>"


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One WARC record as a gzip member without time stamp."""
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    return member([*headers, ("Content-Type", "application/http; msgtype=response")], block)


class _Roller:
    """The open file of a shard: written under a temporary name, renamed when closed."""

    def __init__(self, out: str, shard: int, number: int):
        self.store, root = fs.FileSystem.from_uri(out)
        self.name, self.shard, self.number = f"part-{shard:06d}-{number:05d}.warc.gz", shard, number
        self.temp, self.final = f"{root}/tmp/{self.name}.{uuid.uuid4().hex}", f"{root}/data/{self.name}"
        for d in ("tmp", "data"):
            self.store.create_dir(f"{root}/{d}", recursive=True)
        self.stream, self.sha, self.bytes, self.records, self.first, self.last = self.store.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0, None, None
        self.put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def add(self, data: bytes, page_id: int | None) -> None:
        self.put(data)
        self.records += 1
        self.first = page_id if self.first is None else self.first
        self.last = page_id

    def close(self) -> dict:
        self.stream.close()
        self.store.move(self.temp, self.final)
        return {"file": self.name, "shard": self.shard, "number": self.number, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest(), "first_page": self.first, "last_page": self.last}


def _write(batches: Iterator[pa.RecordBatch], out: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("number", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64())])
    now: _Roller | None = None
    for b in batches:
        done = []
        for shard, page_id, url, payload, digest, refers_to in zip(*(b.column(c) for c in ("shard", "page_id", "url", "payload", "digest", "refers_to"))):
            shard, page_id = shard.as_py(), page_id.as_py()
            if now is not None and (now.shard != shard or now.bytes >= roll_bytes):
                number = now.number + 1 if now.shard == shard else 0
                done.append(now.close())
                now = _Roller(out, shard, number)
            now = now or _Roller(out, shard, 0)
            now.add(page_record(page_id, url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()), page_id)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.close()], schema)


def prepared(pages: DataFrame, least: int = 100, broadcast_digests: int = 200_000) -> DataFrame:
    """page_id, url, payload, digest, refers_to.  Digests that repeat are counted, and broadcast only up to ``broadcast_digests``, so payloads are not shuffled for the join."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = table(firsts.where("n > 1").drop("n"), "warc-firsts")
    joined = rows.join(F.broadcast(firsts) if firsts.count() <= broadcast_digests else firsts, "digest", "left")
    return joined.withColumn("refers_to", F.when(large & (F.col("page_id") > F.col("first")), F.col("first"))).drop("first")


def shard_cuts(pages: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (first page_id, its shard, shards its own rows are dealt over), one a shard and one more for an id of several shards.

    The exact running sum of bytes along the ids: inside the ranges that Spark sorts, then over the ranges' totals.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + 500
    by_id = pages.groupBy(F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))).alias("id")).agg(F.sum(size).alias("b"))
    ranged = table(by_id.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "warc-sizes")
    totals = ranged.groupBy("part").agg(F.sum("b").alias("all"))  # one row a shuffle partition
    before = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("b").over(Window.partitionBy("part").orderBy("id"))
    begun = ranged.join(F.broadcast(before), "part").select("id", (inside + F.col("before")).alias("end"), "b")
    shard = lambda x: F.floor(x / F.lit(shard_bytes))
    begun = begun.select("id", shard(F.col("end") - F.col("b")).alias("shard"), F.greatest(F.lit(1), shard(F.col("end")) - shard(F.col("end") - F.col("b"))).alias("pieces"))
    cuts = begun.groupBy("shard").agg(F.min("id").alias("id"), F.lit(1).alias("pieces")).select("id", "shard", "pieces").unionByName(begun.where("pieces > 1").select("id", "shard", "pieces"))
    got = cuts.groupBy("id", "shard").agg(F.max("pieces").alias("pieces")).orderBy("id").toArrow()
    return tuple(got.column(c).to_numpy().astype(np.int64) for c in ("id", "shard", "pieces"))


def write_warc(pages: DataFrame, out: str, roll_bytes: int = 8 << 20, shard_bytes: int = 64 << 20, least: int = 100) -> DataFrame:
    """Write pages(page_id, url, html) under the folder ``out`` (a URI all executors share); returns the manifest."""
    spark = pages.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(shard_cuts(pages, shard_bytes))
    shards = int((sent.value[1] + sent.value[2]).max()) if len(sent.value[0]) else 0

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shard, pieces = sent.value
        for b in batches:
            at = np.searchsorted(first, b.column("page_id").fill_null(-(1 << 63)).to_numpy(), "right") - 1
            number = shard[at] + b.column("deal").to_numpy() % pieces[at]
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), *b.columns[:-1]], names=["shard", *b.schema.names[:-1]])

    columns = "page_id long, url string, payload binary, digest string, refers_to long"
    rows = prepared(pages, least).select(*(c.split()[0] for c in columns.split(", ")), F.pmod(F.xxhash64("digest", "url"), F.lit(1 << 40)).alias("deal")).mapInArrow(dealt, f"shard int, {columns}")
    # by number, not by hash: two shards never share a task
    ordered = rows.repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "url")
    made = ordered.mapInArrow(lambda x: _write(x, out, roll_bytes), _MANIFEST)
    made.write.json(f"{out}/manifest")
    return spark.read.schema(_MANIFEST).json(f"{out}/manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members, each decompressed from bounded chunks, so the work is linear in the file."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, got = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a WARC file ends inside a record")
            chunk = view[at : at + _CHUNK]
            got.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
        yield b"".join(got)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for b in batches:
        for sha, content in zip(b.column("sha256"), b.column("content")):
            data = content.as_py()
            if hashlib.sha256(data).hexdigest() != sha.as_py():
                raise ValueError("a WARC file differs from its manifest")
            rows = []
            for record in members(data):
                fields, block = parse(record)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                    raise ValueError("a record differs from its block digest")
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rsplit(b"Content-Length: ", 1)[1])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                whole = fields["WARC-Type"] == "response"
                if whole and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError("a payload differs from its digest")
                number = lambda k: int(fields[k]) if k in fields else None
                rows.append({"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if whole else None})
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """Records of all files of the committed manifest under ``out``; fails without its marker, and where bytes and digests differ."""
    tune(spark)
    if not exists(spark, f"{out}/manifest/_SUCCESS"):
        raise ValueError(f"no committed manifest under {out}")
    manifest = spark.read.schema(_MANIFEST).json(f"{out}/manifest")
    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], _RECORD)
    # files of another run or attempt are not in the manifest, which has one short row a file
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{out}/data").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(manifest.select("file", "sha256"), "file").mapInArrow(_read, _RECORD)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """The registered query: write all pages, read the archives back."""
    spark = pages.sparkSession
    out = f"{shared_dir(spark)}/frostline/warc-{uuid.uuid4().hex}"
    write_warc(pages, out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
