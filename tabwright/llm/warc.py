"""WARC archives: a deterministic sharded writer and the reader for what it wrote."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import order_statistics, with_buckets
from ..session import scratch_table
from .common import Scratch, text_of

SHARD_BYTES = 64 << 20      # payload bytes per key range, before compression
ROLL_BYTES = 16 << 20       # a file is closed by the record that brings it to this size, compressed
REVISIT_FROM = 1000         # payloads below this many bytes are always written out
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
CHUNK = 1 << 20


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _uri(url: str | None, page_id) -> str:
    """The url without characters that would end a header; pages without one get a name."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own; the same input always gives the same bytes."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"WARC-Block-Digest: {_digest(block)}",
             f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def page_member(page_id, url, payload: bytes, copy: int, revisit: bool, refers_to) -> bytes:
    digest = _digest(payload)
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id, digest, copy)),
               ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", digest),
               ("Content-Type", "application/http; msgtype=response"),
               ("X-Page-ID", "" if page_id is None else page_id), ("X-Payload-Length", len(payload))]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to, digest, 0)),
                    ("X-Refers-To-Page", "" if refers_to is None else refers_to)]
        return member(headers, block)
    return member(headers, block + payload)


class Roll:
    """The files of one key range: written under temporary names, renamed when they are complete.

    Two attempts of a task write the same bytes to the same final names, so it does
    not matter which of them ends last.
    """

    def __init__(self, root: str, shard: int, limit: int):
        self.files, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.limit, self.roll, self.out = shard, limit, 0, None
        for folder in ("_temporary", "data"):
            self.files.create_dir(f"{self.root}/{folder}", recursive=True)

    def add(self, data: bytes):
        """Write a record; the manifest row of the file if that was its last."""
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.roll:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.files.open_output_stream(self.temporary, compression=None)
            self.sha, self.bytes, self.records = hashlib.sha256(), 0, 0
            self._write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(self.name)), ("WARC-Date", DATE),
                                ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")],
                               b"format: WARC File Format 1.1\r\n"))
        self._write(data)
        self.records += 1
        return self.close() if self.bytes >= self.limit else None

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        self.files.move(self.temporary, f"{self.root}/data/{self.name}")
        self.out, self.roll = None, self.roll + 1
        return self.name, self.records, self.bytes, self.sha.hexdigest()


def _whole(value):
    return None if value is None or pd.isna(value) else int(value)


def _writer(root: str, limit: int, revisit_from: int):
    def run(batches):
        roll, at, before, copy, target = None, None, None, 0, (False, None)
        for batch in batches:
            done = []
            for shard, page_id, digest, kind, refers_to, url, html in zip(
                    batch["shard"], batch["page"], batch["digest"], batch["kind"], batch["refers_to"], batch["url"],
                    batch["html"]):
                page_id = _whole(page_id)
                if shard != at:
                    if roll:
                        done.append(roll.close())
                    roll, at, before = Roll(root, shard, limit), shard, None
                if (page_id, digest) != before:
                    before, copy, target = (page_id, digest), 0, (False, None)
                if kind == 0:   # tells that the records with this id and digest revisit another
                    target = (True, _whole(refers_to))
                    continue
                payload = html.encode()
                done.append(roll.add(page_member(page_id, url, payload, copy, *target)))
                copy += 1
                if len(payload) >= revisit_from and not target[0]:
                    target = (True, page_id)   # further copies of the same row
            yield pd.DataFrame([d for d in done if d], columns=["file", "records", "bytes", "sha256"])
        if roll and (last := roll.close()):
            yield pd.DataFrame([last], columns=["file", "records", "bytes", "sha256"])
    return run


def write(pages: DataFrame, root: str, page_id="page_id", url="url", html="html", shard_bytes: int = SHARD_BYTES,
          roll_bytes: int = ROLL_BYTES, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write one record per row below ``root`` and return the manifest (file, records, bytes, sha256).

    Rows are cut into key ranges at exact ranks of the id, each range is sorted by id
    and payload digest and written by one task, and a new file is begun when the
    compressed size reaches ``roll_bytes``. Neither names nor bytes depend on the
    cluster. Files count only once ``root/manifest`` is complete, which Spark writes
    last.

    Of rows with equal payloads of at least ``revisit_from`` bytes the one with the
    largest id is the response and the others revisit it; of identical rows the first
    is the response. A null html is an empty payload. Rows without an id come in
    ranges of their own, by digest; they revisit an equal payload that has an id. An
    empty table gives an empty manifest. Other columns of the input are not read.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    payload = text_of(html)
    narrow = scratch.keep(pages.select(F.col(page_id).alias("page"), F.sha1(payload.cast("binary")).alias("digest"),
                                       F.octet_length(payload).cast("long").alias("size")), "payloads")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    _, ranks = order_statistics(narrow, {"page": lambda n: [n * i // shards for i in range(1, shards)]})["page"]
    cuts = sorted(set(ranks.values()))

    largest = (narrow.where(F.col("size") >= revisit_from).groupBy("digest")
               .agg(F.max("page").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    revisits = (narrow.where(F.col("size") >= revisit_from).join(largest, "digest")
                .where("not page <=> refers_to").select("page", "digest", "refers_to").distinct())
    text = {c: F.lit(None).cast("string").alias(c) for c in ("url", "html")}
    told = revisits.select("page", "digest", F.lit(0).alias("kind"), "refers_to", *text.values())
    records = pages.select(F.col(page_id).alias("page"), F.sha1(payload.cast("binary")).alias("digest"),
                           F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"),
                           F.col(url).cast("string").alias("url"), payload.alias("html"))
    rows = with_buckets(told.unionByName(records), {"page": cuts})
    spread = F.conv(F.substring("digest", 1, 2), 16, 10).cast("int")   # rows without an id: 256 ranges
    rows = rows.withColumn("shard", F.when(F.col("page").isNull(), F.lit(len(cuts) + 2) + spread)
                           .otherwise(F.col("_b_page"))).drop("_b_page")
    rows = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "page", "digest", "kind")
    rows.mapInPandas(_writer(root, roll_bytes, revisit_from), MANIFEST).write.json(f"{root}/manifest")
    scratch.drop("payloads")
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def members(stream):
    """The decompressed gzip members of a stream, one after the other."""
    data, decoder, parts = stream.read(CHUNK), zlib.decompressobj(31), []
    while data:
        parts.append(decoder.decompress(data))
        data = decoder.unused_data if decoder.eof else b""
        if decoder.eof:
            yield b"".join(parts)
            decoder, parts = zlib.decompressobj(31), []
        data = data or stream.read(CHUNK)
    if parts and any(parts):
        raise ValueError("an archive ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises if its block digest is wrong."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block):] != b"\r\n\r\n" or _digest(block) != headers["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def _row(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(headers[name]) if headers.get(name) else None
    response = headers["WARC-Type"] == "response"
    payload = block.partition(b"\r\n\r\n")[2]
    if response and (_digest(payload) != headers["WARC-Payload-Digest"] or len(payload) != number("X-Payload-Length")):
        raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
    digest = base64.b32decode(headers["WARC-Payload-Digest"].partition(":")[2]).hex()
    return number("X-Page-ID"), number("X-Payload-Length"), digest, headers["WARC-Type"], number("X-Refers-To-Page")


def read(spark: SparkSession, root: str) -> DataFrame:
    """One row per page record of the archives in the manifest, with digests checked.

    Files are read as streams, one record at a time. A file with more or fewer
    records than its manifest row says is an error.
    """
    manifest = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for file, records in zip(batch["file"], batch["records"]):
                store, path = fs.FileSystem.from_uri(root)
                found, n = [], 0
                with store.open_input_stream(f"{path}/data/{file}", compression=None) as stream:
                    for record in members(stream):
                        headers, block = parse(record)
                        if headers["WARC-Type"] in ("response", "revisit"):
                            found.append(_row(headers, block))
                            n += 1
                        if len(found) == 10_000:
                            yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            found = []
                if n != records:
                    raise ValueError(f"{file} has {n} records, its manifest row says {records}")
                yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = manifest.select("file", "records")
    return files.repartition(max(1, files.count()), "file").mapInPandas(run, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all rows to a new folder below the shared one and read them back."""
    root = scratch_table(pages.sparkSession, "llm-warc")
    write(pages, root, **options)
    return read(pages.sparkSession, root)
