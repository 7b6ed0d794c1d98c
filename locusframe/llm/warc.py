"""Deterministic sharded WARC writer and reader (operator 4).

Records are range-sorted by id and payload digest.  Range bounds are quantiles
of payload bytes, taken from the rows whose digests' hashes are least, so they
depend on the rows only; an id that many rows share is cut by digest.  A shard
is a task.  A task streams its sorted rows into gzip members, one a record, and
rolls to a new file when the compressed size is reached.  Headers, record ids
and digests are made anew from the record.  A file is written under a
temporary name and renamed when it is whole; the manifest, a table that Spark
commits as a whole, names the files that count.  A task that runs again writes
the same bytes under the same names.

Files are written through pyarrow's file systems (file, hdfs, s3, gs, ...), so
the folder must have such a scheme.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import attach, materialize, scratch

#: Shards at most, and rows per shard that the bounds are taken from.
MOST_SHARDS, SAMPLED = 8192, 64
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, shard int, part int, records bigint, bytes bigint, sha1 string"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_id(key: object, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{key}/{sha1}')}>"


def clean(value: str | None) -> str:
    """A header value without control characters, which are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(key: object, url: str | None, payload: bytes, sha1: str, refers: object | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, not compressed. A revisit carries no payload; its HTTP header states the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, sha1)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean(url)}")
    if key is not None:
        lines.append(f"X-Record-Key: {key}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, sha1)}", f"X-Refers-To-Key: {refers}"]
    lines += [
        f"WARC-Payload-Digest: {b32(bytes.fromhex(sha1))}",
        f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class RollingWriter:
    """Writes a shard's records to files of about ``roll`` compressed bytes."""

    def __init__(self, folder: str, shard: int, roll: int, level: int):
        self.fs, self.folder = file_system(folder)
        self.shard, self.roll, self.level, self.part, self.stream = shard, roll, level, 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.stream is None:
            self.temp = f"{self.folder}/.tmp-{uuid.uuid4().hex}"
            self.stream, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha1()
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.stream.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.stream is not None:
            self.stream.close()
            name = f"shard-{self.shard:07d}-{self.part:05d}.warc.gz"
            self.fs.move(self.temp, f"{self.folder}/{name}")
            yield name, self.shard, self.part, self.records, self.size, self.sha.hexdigest()
            self.part, self.stream = self.part + 1, None


def members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The records of a gzip file of one member a record, reading a block at a time."""
    rest = b""
    while True:
        chunk = rest or stream.read(1 << 20)
        if not chunk:
            return
        reader, parts = zlib.decompressobj(31), []
        while chunk:
            parts.append(reader.decompress(chunk))
            if reader.eof:
                break
            chunk = stream.read(1 << 20)
        if not reader.eof:
            raise ValueError("the archive ends within a record")
        rest = reader.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload; digests are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(warc["content-length"])]
    if b32(hashlib.sha1(block).digest()) != warc["warc-block-digest"]:
        raise ValueError(f"block digest of {warc['warc-record-id']} differs")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http_head.decode().split("\r\n")[1:])}
    if warc["warc-type"] == "response" and b32(hashlib.sha1(payload).digest()) != warc["warc-payload-digest"]:
        raise ValueError(f"payload digest of {warc['warc-record-id']} differs")
    return warc, http, payload


def place(key: str | None, sha1: str) -> tuple[int, int, str]:
    """Where a record stands in the order of all: null keys first, then keys, then digests."""
    return (0, 0, sha1) if key is None or key != key else (1, int(key), sha1)


def shard_bounds(meta: DataFrame, shard_bytes: int) -> list[tuple[int, int, str]]:
    """The places at which shards but the first begin.

    Shards are weighed by their payload and 512 bytes a record.  Their bounds
    are quantiles over the rows whose hash of key and digest falls below a
    rate that gives ``SAMPLED`` rows a shard: a bounded sample that depends on
    the rows only; every row is dealt by the bounds.
    """
    weight = F.col("size") + 512
    whole = meta.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    shards = min(MOST_SHARDS, -(-int(whole["bytes"]) // shard_bytes))
    if shards < 2:
        return []
    every = max(1, int(whole["n"]) // (SAMPLED * shards))
    some = meta.where(F.pmod(F.xxhash64("key", "sha1"), F.lit(every)) == 0).groupBy("key", "sha1").agg(F.sum(weight).alias("w"))
    rows = sorted((place(None if r["key"] is None else str(r["key"]), r["sha1"]), int(r["w"])) for r in some.collect())  # about SAMPLED * MOST_SHARDS
    total, full, out = sum(w for _, w in rows), 0, []
    for at, w in rows:
        if full * shards >= (len(out) + 1) * total:
            out.append(at)
        full += w
    return out


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    body: str = "html",
    least_revisit: int = 1000,
    shard_bytes: int = 32 << 20,
    roll_bytes: int = 4 << 20,
    level: int = 6,
) -> DataFrame:
    """Write a record per row into ``folder`` and return the manifest.

    Of rows with equal payloads of at least ``least_revisit`` bytes the one
    with the largest key is the response (all that share this key, if rows
    repeat), others are revisits of it.  A null body is an empty payload; a
    row with a null key is a response and lies in the first shards.  A shard
    holds about ``shard_bytes`` of payload (more where they would number more
    than ``MOST_SHARDS``), a file about ``roll_bytes`` of compressed records.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(body), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))
    meta = materialize(rows.select("key", "sha1", F.octet_length("payload").cast("long").alias("size")), "meta")
    bounds = shard_bounds(meta, shard_bytes)
    held_bounds = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def shard_of(key: pd.Series, sha1: pd.Series) -> pd.Series:
        cuts = held_bounds.value
        return pd.Series([bisect.bisect_right(cuts, place(k, s)) for k, s in zip(key.array, sha1, strict=True)], dtype="int32")

    large = meta.where((F.col("size") >= least_revisit) & F.col("key").isNotNull())
    copies = materialize(large.groupBy("sha1").agg(F.max("key").alias("refers"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    notices = attach(large.select("key", "sha1"), copies, "sha1").where("key < refers")
    empty = F.lit(None).cast("string")
    notices = notices.select("key", empty.alias("url"), empty.alias("payload"), "sha1", "refers").distinct()
    every = rows.withColumn("refers", F.lit(None).cast("long")).unionByName(notices)
    every = every.withColumn("shard", shard_of(F.col("key").cast("string"), "sha1")).withColumn("notice", F.col("refers").isNotNull())
    # what says that a row is a revisit is sorted before the row itself
    ordered = every.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("key", F.desc("notice"), "sha1", "url")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        current, refers = None, {}
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "key", "url", "payload", "sha1", "refers")]
            for i in range(batch.num_rows):
                shard, k, u, body_, sha, ref = (c[i].as_py() for c in columns)
                if writer is None or writer.shard != shard:
                    if writer is not None:
                        done += writer.close()
                    writer = RollingWriter(folder, shard, roll_bytes, level)
                if k != current:
                    current, refers = k, {}
                if ref is not None:
                    refers[sha] = ref
                    continue
                target = refers.get(sha)
                done += writer.add(record(k, u, body_.encode(), sha, target, target is not None))
        if writer is not None:
            done += writer.close()
        if done:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["file", "shard", "part", "records", "bytes", "sha1"])

    written = ordered.select("shard", "key", "url", "payload", "sha1", "refers").mapInArrow(write, MANIFEST)
    written.write.parquet(f"{folder}/_manifest")
    manifest = spark.read.schema(written.schema).parquet(f"{folder}/_manifest")
    for info in fs.get_file_info(pafs.FileSelector(path)):
        if info.base_name.startswith(".tmp-"):  # of attempts that ended early
            fs.delete_file(info.path)
    return manifest


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the manifest's files: key, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        names = ["key", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        rows, held = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(stream):
                        warc, http, payload = parse(data)
                        response = warc["warc-type"] == "response"
                        sha = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                        key, refers = warc.get("x-record-key"), warc.get("x-refers-to-key")
                        rows.append((None if key is None else int(key), warc.get("warc-target-uri"), payload if response else None, int(http["content-length"]), sha, warc["warc-type"], None if refers is None else int(refers)))
                        held += len(data)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = manifest.select("file").repartition(256, "file")
    return files.mapInArrow(read, "key bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(spark: SparkSession, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Write all pages into a new folder of the shared folder and read the archives back."""
    folder = scratch(spark, "warc")
    return read_archives(write_archives(pages, folder, key=key), folder).withColumnRenamed("key", key)


#: For DuckDB.
ORACLE = """
with p as (select page_id, coalesce(html, '') as body, cast(strlen(coalesce(html, '')) as bigint) as n from pages),
w as (select *, max(page_id) over (partition by body) as top from p)
select page_id, n as payload_bytes, sha1(body) as payload_digest,
  case when n >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < top then top end as refers_to
from w
"""
