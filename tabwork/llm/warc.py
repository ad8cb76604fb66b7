"""A deterministic sharded WARC writer and its reader.

Records are encoded once, in the tasks that read the pages (headers, payload digest, one gzip
member each), so that only compressed records are shuffled.  They are dealt to shards that are
ranges of the page id, cut by running payload bytes in id order, sorted inside a shard, and rolled into files by
compressed size; read in the order of their names, the files are in the order of the ids.  A task writes under a temporary name and returns a manifest row; the manifest is
saved, and only then are the named files moved to their final names by a second, repeatable job.
A lost or repeated task leaves a stray temporary file that no manifest names.

Defined cases: records without an id, or of one id with more bytes than a shard, are dealt over as many shards as
they need (null ids first); a null html is an empty payload; a null page id is kept and read back as null (it
never counts as the largest id); records with equal payload and equal, largest page id are all
responses; columns other than the id, url and html are not archived; an empty table writes no file.
"""
from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import cumulative_sum
from .common import lookup, saved, scratch, table

REVISIT_FROM = 1000          # payloads of at least this many bytes are stored once
SHARD_BYTES = 32 << 20       # payload bytes that make one shard
FILE_BYTES = 16 << 20        # compressed bytes after which the next file begins
DATE = "1970-01-01T00:00:00Z"  # no clock: equal input gives equal files
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value

ENCODED = "page_id long, url string, digest string, payload_bytes long, record binary, shard int"
MANIFEST = "shard int, seq int, temporary string, name string, records long, bytes long, sha1 string"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _member(head: str, block: bytes) -> bytes:
    """One gzip member without a time stamp: header lines, a blank line, the block."""
    raw = (head + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def _head(kind: str, page_id, url, digest: str, extra: str = "") -> str:
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    shown = "" if page_id is None else f"WARC-Page-ID: {page_id}\r\n"
    target = "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url or "")
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\n"
            f"WARC-Target-URI: {target}\r\n{shown}WARC-Payload-Digest: sha1:{digest}\r\n{extra}"
            "Content-Type: application/http; msgtype=response\r\n")


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _encode(shards: Broadcast):
    """A complete response record for every page, with its shard."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, repeats = shards.value, Counter()
        for batch in batches:
            ids, urls, bodies = (batch.column(i) for i in range(3))
            first, parts = cut.of(ids)
            digests, sizes, records = [], [], []
            for i, (page_id, url, body) in enumerate(zip(ids, urls, bodies, strict=True)):
                payload = body.as_buffer().to_pybytes() if body.is_valid else b""
                digest = hashlib.sha1(payload).hexdigest()
                digests.append(digest)
                sizes.append(len(payload))
                records.append(_member(_head("response", page_id.as_py(), url.as_py(), digest), _http(len(payload)) + payload))
                if parts[i] > 1:  # by content; repeated rows by their place in the table
                    salt = zlib.crc32(f"{digest}{url.as_py()}".encode())
                    first[i] += (salt + repeats[salt]) % parts[i]
                    repeats[salt] += 1
            yield pa.RecordBatch.from_arrays(
                [ids, urls, pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(records, pa.binary()), pa.array(first, pa.int32())],
                ["page_id", "url", "digest", "payload_bytes", "record", "shard"])

    return encode


@dataclass
class Shards:
    """Largest id of every shard, its number, and the parts of that id; ``nulls`` shards of null ids come first.

    24 bytes for shard_bytes of payload: that is what is broadcast.
    """

    upper: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    nulls: int
    total: int

    def of(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First shard of every id, and over how many its records are dealt."""
        at = ids.fill_null(0).to_numpy(zero_copy_only=False)
        null = np.array(ids.is_null(), bool)
        first, parts = np.zeros(len(at), np.int64), np.where(null, max(1, self.nulls), 1)
        if len(self.upper):
            spot = np.minimum(np.searchsorted(self.upper, at), len(self.upper) - 1)
            first = np.where(null, 0, self.first[spot])
            parts = np.where(~null & (at == self.upper[spot]), self.parts[spot], parts)
        return first, parts


def shards_of(facts: DataFrame, shard_bytes: int) -> Shards:
    """Shards of about ``shard_bytes`` of payload, from the running bytes in the order of the ids.

    An id that begins in a shard goes there whole; one of more bytes than a shard, always the largest
    of the shard it begins in, is dealt over all the shards its bytes span.  Sums run over range buckets, so no task
    sees all ids, and a few numbers a shard come to the driver.
    """
    sizes = saved(facts.groupBy("page_id").agg(F.sum(F.col("payload_bytes") + 512).alias("bytes")), "warc-ids")
    nulls = sizes.filter("page_id IS NULL").agg(F.sum("bytes")).first()[0] or 0
    nulls = -(-nulls // shard_bytes)
    running = cumulative_sum(sizes.filter("page_id IS NOT NULL"), "page_id", ["bytes"])
    first = F.floor((F.col("bytes_cum") - F.col("bytes")) / F.lit(shard_bytes))
    last = F.floor((F.col("bytes_cum") - 1) / F.lit(shard_bytes))
    parts = F.when(F.col("bytes") > shard_bytes, last - first + 1).otherwise(1)
    rows = (running.select("page_id", first.alias("first"), last.alias("last"), parts.alias("parts")).groupBy("first")
            .agg(F.max("page_id").alias("upper"), F.max("parts").alias("parts"), F.max("last").alias("last")).orderBy("first").collect())
    column = lambda name: np.array([r[name] for r in rows], np.int64)
    return Shards(column("upper"), column("first") + nulls, column("parts"), nulls, nulls + 1 + (rows[-1].last if rows else 0))


class _File:
    """An archive file that grows in memory up to its rolling size."""

    def __init__(self, shard: int, seq: int):
        self.shard, self.seq, self.parts, self.bytes = shard, seq, [], 0

    def add(self, record: bytes) -> None:
        self.parts.append(record)
        self.bytes += len(record)

    def put(self, path: str) -> tuple:
        """Write under a temporary name no other attempt uses; give the manifest row."""
        store, folder = pafs.FileSystem.from_uri(path)
        name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
        temporary = f"_temporary/{name}.{uuid.uuid4().hex}"
        digest = hashlib.sha1()
        store.create_dir(f"{folder}/_temporary", recursive=True)
        with store.open_output_stream(f"{folder}/{temporary}", compression=None) as out:
            for p in self.parts:
                out.write(p)
                digest.update(p)
        return self.shard, self.seq, temporary, name, len(self.parts), self.bytes, digest.hexdigest()


def _writer(path: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                record = row["record"]
                if row["refers_to"] is not None:
                    extra = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To-Page-ID: {row['refers_to']}\r\n"
                    head = _head("revisit", row["page_id"], row["url"], row["digest"], extra)
                    record = _member(head, _http(row["payload_bytes"]))
                if now is not None and (now.shard != row["shard"] or now.bytes + len(record) > file_bytes):
                    done.append(now.put(path))
                    now = _File(row["shard"], now.seq + 1 if now.shard == row["shard"] else 0)
                now = now or _File(row["shard"], 0)
                now.add(record)
        if now is not None:
            done.append(now.put(path))
        columns = list(zip(*done, strict=True)) if done else [[] for _ in range(7)]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         [c.split()[0] for c in MANIFEST.split(", ")])
    return write


def _mover(path: str):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                here, there = f"{folder}/{row['temporary']}", f"{folder}/{row['name']}"
                if store.get_file_info(here).type != pafs.FileType.NotFound:
                    store.move(here, there)
                if store.get_file_info(there).size != row["bytes"]:
                    raise OSError(f"archive {row['name']} was not committed")
            yield batch
    return move


def write_archive(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path``; return the manifest.

    ``path`` is a URI that the tasks can open (shared storage).
    """
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                          F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    facts = saved(source.select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"),
                                F.sha1("html").alias("digest")), "warc-facts")
    groups = saved(facts.filter(F.col("payload_bytes") >= REVISIT_FROM).groupBy("digest")
                   .agg(F.max("page_id").alias("last_id"), F.count("*").alias("n"))
                   .filter("n > 1"), "warc-groups")
    shards = shards_of(facts, shard_bytes)
    encoded = source.mapInArrow(_encode(pages.sparkSession.sparkContext.broadcast(shards)), ENCODED)
    # a shorter payload can't share a digest with one of REVISIT_FROM bytes
    known = lookup(encoded, "digest", groups, "last_id", "n", facts.count(), ["page_id", "url"])
    older = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    # the record of a page that will be a revisit need not travel
    placed = (known.withColumn("refers_to", F.when(older, F.col("last_id")))
              .withColumn("record", F.when(~older | F.col("last_id").isNull(), F.col("record")))
              .repartition(4 * (shards.total + 1), "shard")  # more tasks than shards: few tasks get two
              .sortWithinPartitions("shard", "page_id", "digest", "url"))
    placed = placed.select("shard", "page_id", "url", "digest", "payload_bytes", "refers_to", "record")
    manifest = saved(placed.mapInArrow(_writer(path, file_bytes), MANIFEST), "warc-manifest")
    return saved(manifest.mapInArrow(_mover(path), MANIFEST), "warc-committed")


def _records(body: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of every record of an archive, one gzip member at a time."""
    whole, at = memoryview(body), 0
    while at < len(whole):
        member, raw = zlib.decompressobj(31), []
        while not member.eof:
            piece = whole[at:at + 65536]
            if not len(piece):
                raise OSError("archive ends inside a record")
            raw.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[:int(fields["Content-Length"])]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in _records(content.as_buffer()):
                http, _, payload = block.partition(b"\r\n\r\n")
                lines = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise OSError(f"payload digest differs in {fields['WARC-Record-ID']}")
                page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
                rows.append((page and int(page), int(lines["Content-Length"]), digest, kind, refers and int(refers)))
            columns = list(zip(*rows, strict=True))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 [c.split()[0] for c in PAGES.split(", ")])


def read_archive(spark, path: str) -> DataFrame:
    """One row per record of the committed files; response payloads are checked against their digests.

    Files below ``_temporary`` were never committed and are not listed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(_parse, PAGES)


def op4_warc_writer(spark, sf_dir):
    path = scratch(spark, "warc")
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    manifest = write_archive(table(spark, sf_dir, "pages"), path)
    return spark.createDataFrame([], PAGES) if manifest.isEmpty() else read_archive(spark, path)


OP4_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS last_id FROM d WHERE payload_bytes >= {REVISIT_FROM} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last_id IS NULL OR last_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last_id IS DISTINCT FROM page_id THEN last_id END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""
