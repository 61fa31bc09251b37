"""WARC archives as bundles of independent Zstandard frames with a footer seek table.

Every page becomes a record of a WARC/1.1 file: `response`, or `revisit` of the response with the
same payload. Records are grouped into frames of about `FRAME_BYTES`, each compressed on its own; a
bundle ends in a skippable frame that lists the frames' sizes (the seekable Zstandard format), so any
reader can unpack one frame without the rest, and any plain Zstandard tool the whole. The index maps a
record's identifier to bundle, frame and offset in the frame.

Which record is the response is found by an aggregation of digests (map-side combined, so thousands
of equal pages cost a row a task) and a join. A task streams its rows into bundles of its own, under a
name that no other attempt has; only bundles named in the written index count, so lost executors
and repeated attempts leave nothing wrong. Memory holds one frame at a time.

Defined results: null or empty html has an empty payload (and is deduplicated like any other); rows
with a payload under `min_bytes` are all responses; the smallest page_id of equal payloads is the
response, rows repeating that page_id are responses too; a null page_id never is the smallest, and
reads back as null; null urls are written as "urn:x-none"; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import common

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
FRAMES_A_READ = 8
READ_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "record_id string, bundle string, frame int, frame_at long, frame_bytes long, at long, length long"
_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"urn:x-page:{'null' if page_id is None else page_id}"


def _page_of(record: str | None) -> int | None:
    tail = record.strip("<>").rsplit(":", 1)[1] if record else "null"
    return None if tail == "null" else int(tail)


def digest_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; first: the page whose payload this one repeats."""
    revisit = first is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "urn:x-none") if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{record_id(first)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Bundles of one task; a row of the index for each record."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=3)
        self.fs, self.path = open_fs(folder)
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.out = None

    def add(self, rid: str, raw: bytes) -> list[tuple]:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.fs.create_dir(self.path, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.table, self.at = [], 0
            self.frame, self.waiting = io.BytesIO(), []
        self.waiting.append((rid, self.frame.tell(), len(raw)))
        self.frame.write(raw)
        done = self.end_frame() if self.frame.tell() >= self.frame_bytes else []
        if self.at >= self.bundle_bytes:
            self.close()
        return done

    def end_frame(self) -> list[tuple]:
        if self.out is None or not self.waiting:
            return []
        raw = self.frame.getvalue()
        packed = self.pack.compress(raw)
        self.out.write(packed)
        rows = [(rid, f"{self.folder}/{self.name}", len(self.table), self.at, len(packed), at, n) for rid, at, n in self.waiting]
        self.table.append((len(packed), len(raw)))
        self.at += len(packed)
        self.frame, self.waiting = io.BytesIO(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.end_frame()
        if self.out is not None:
            body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
            self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
            self.out.close()
            self.out = None
        return rows


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, packed bytes, plain bytes) of every frame of an open bundle."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable Zstandard file")
    file.seek(size - 9 - 8 * n)
    raw, at, out = file.read(8 * n), 0, []
    for packed, plain in struct.iter_unpack("<II", raw):
        out.append((at, packed, plain))
        at += packed
    return out


def parse(raw: bytes):
    """(headers, block) of each record of a plain frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield head, raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def read_record(bundle: str, frame: int, at: int, length: int) -> bytes:
    """One record by its place in the index, unpacking its frame alone."""
    import zstandard

    fs, path = open_fs(bundle)
    with fs.open_input_file(path) as f:
        offset, packed, plain = seek_table(f, f.size())[frame]
        f.seek(offset)
        return zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)[at : at + length]


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    names = [c.split()[0] for c in INDEX.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def as_batch(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches):
        out = BundleWriter(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            rows = []
            cols = [batch.column(c) for c in ("page_id", "url", "html", "sha1", "first")]
            for page, url, html, sha1, first in zip(*cols, strict=True):
                page, payload = page.as_py(), (html.as_py() or "").encode()
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                rows += out.add(record_id(page), record(page, url.as_py(), payload, digest, first.as_py()))
            yield as_batch(rows)
        yield as_batch(out.close())

    return run


def write(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the archives under folder and returns their index."""
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"], F.sha1(html.cast("binary")).alias("sha1"))
    least = rows.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    shared = least.filter((F.col("n") > 1) & F.col("least").isNotNull()).select("sha1", "least")
    marked = rows.join(shared, "sha1", "left").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")))
    return common.materialize(marked.select("page_id", "url", "html", "sha1", "first").mapInArrow(_write(folder, frame_bytes, bundle_bytes), INDEX), "warc-index")


def _read(batches):
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for bundle, group in zip(batch.column("bundle").to_pylist(), batch.column("group").to_pylist(), strict=True):
            fs, path = open_fs(bundle)
            rows = []
            with fs.open_input_file(path) as f:
                for offset, packed, plain in seek_table(f, f.size())[group * FRAMES_A_READ : (group + 1) * FRAMES_A_READ]:
                    f.seek(offset)
                    for head, block in parse(unpack.decompress(f.read(packed), max_output_size=plain)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response" and (len(payload) != size or digest_text(payload) != digest):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']} in {bundle}")
                        refers = _page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                        rows.append((_page_of(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=[c.split()[0] for c in _PAGES.split(", ")])


def read(index: DataFrame) -> DataFrame:
    """One row per record of the archives that the index names; payloads are held against their digests.

    A unit of work is a run of FRAMES_A_READ frames. Units are rows of a few bytes that stand for megabytes, so
    they are dealt out by the packed bytes behind them, not by their own size.
    """
    frames = index.select("bundle", "frame", "frame_bytes").distinct()
    units = frames.groupBy("bundle", F.expr(f"frame div {FRAMES_A_READ}").cast("int").alias("group")).agg(F.sum("frame_bytes").alias("bytes"))
    units = common.materialize(units, "warc-units")
    tasks = max(1, -(-(units.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES))
    return units.select("bundle", "group").repartition(tasks).mapInArrow(_read, _PAGES)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    index = write(common.table(spark, sf_dir, "pages"), common.shared_path(spark, "warc"))
    return read(index)


OP8_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (  -- the digest's 160 bits in groups of five, as letters
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS least,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to FROM b
"""
