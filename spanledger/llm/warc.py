"""Seekable Zstandard bundles of WARC records.

A bundle is a ``.warc.zst`` file of independent Zstandard frames, each holding whole records, and ends with a seek
table in a skippable frame (the public seekable format: 4-byte compressed and decompressed size per frame, then a
9-byte footer). An index table maps every record id to its bundle, frame and offset inside the decompressed frame, so
that one record costs one ranged read and the decompression of one frame.

Edge cases: a null payload is an empty payload; a null id gives a ``response`` record that no other record refers to;
rows that share both id and payload are each a response when that id is the largest of its payload; an empty table
gives no bundles and an empty index; columns other than the two named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import attach

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX_SCHEMA = "record_id string, bundle string, frame int, frame_start long, frame_bytes long, frame_size long, record_offset long, record_bytes long"
RECORD_SCHEMA = "id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Decompressed bytes that one reading task gets.
TASK_BYTES = 32 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_urn(rid: int | None, nth: str) -> str:
    """Record ids are derived from row ids, so a task that runs again writes the same bytes."""
    return f"<urn:record:{rid}>" if rid is not None else f"<urn:record:null-{nth}>"


def warc_record(rid, url: str | None, payload: bytes, refers_to: int | None, nth: str = "0") -> tuple[str, bytes]:
    """One WARC/1.1 record: a response with its payload, or a revisit with HTTP headers only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    urn = record_urn(rid, nth)
    kind = "response" if refers_to is None else "revisit"
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {urn}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_urn(refers_to, '')}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return urn, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of the record that ``raw`` starts with."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    body = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    split = body.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in body[:split].decode().split("\r\n")[1:] if ": " in x)
    return {"version": lines[0], "head": head, "http": http, "payload": bytes(body[split + 4 :])}


class BundleWriter:
    """Writes records as frames of about ``frame_size`` bytes, then the seek table. Holds one frame in memory."""

    def __init__(self, sink, name: str, frame_size: int, level: int):
        self.sink, self.name, self.frame_size = sink, name, frame_size
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.at = 0
        self.buffer: list[bytes] = []
        self.held = 0
        self.waiting: list[tuple[str, int, int]] = []

    def add(self, urn: str, record: bytes) -> Iterator[tuple]:
        self.waiting.append((urn, self.held, len(record)))
        self.buffer.append(record)
        self.held += len(record)
        if self.held >= self.frame_size:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.buffer:
            return
        packed = self.pack.compress(b"".join(self.buffer))
        self.sink.write(packed)
        for urn, offset, size in self.waiting:
            yield urn, self.name, len(self.frames), self.at, len(packed), self.held, offset, size
        self.frames.append((len(packed), self.held))
        self.at += len(packed)
        self.buffer, self.held, self.waiting = [], 0, []

    def close(self) -> Iterator[tuple]:
        yield from self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.sink.close()


def read_seek_table(f) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, from the footer of an open bundle."""
    total = f.size()
    n, flags, magic = struct.unpack("<IBI", f.read_at(9, total - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    entry = 12 if flags & 0x80 else 8
    raw = f.read_at(n * entry, total - 9 - n * entry)
    out, at = [], 0
    for i in range(n):
        size = struct.unpack_from("<I", raw, i * entry)[0]
        out.append((at, size))
        at += size
    return out


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, min_payload_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: the largest id with an equal payload where that is another row's, else null.

    Only digests and ids are grouped. Payloads travel once, in the join that brings the group's id back; a payload
    shared by a large part of the rows is spread over all partitions.
    """
    body = F.coalesce(F.col(payload_col), F.lit(""))
    keyed = pages.withColumn("__sha", F.when(F.octet_length(body) >= min_payload_bytes, F.sha1(body.cast("binary"))))
    groups = keyed.select(F.col(id_col).alias("__id"), "__sha").where("__sha is not null").groupBy("__sha").agg(F.max("__id").alias("__top"), F.count("*").alias("__rows")).where("__rows > 1")
    out = attach(keyed, "__sha", groups, "__top", pages.count(), "__rows")
    top = F.col("__top")
    return out.withColumn("refers_to", F.when(top.isNotNull() & F.col(id_col).isNotNull() & (top != F.col(id_col)), top)).drop("__sha", "__top", "__rn")


def write_archive(pages: DataFrame, scratch: Scratch, id_col="page_id", url_col="url", payload_col="html", frame_size: int = 1 << 20, bundle_size: int = 1 << 28, level: int = 6, min_payload_bytes: int = 0) -> DataFrame:
    """Write bundles below ``scratch`` and return the index table.

    A task writes its bundles under names of its own attempt and moves each into place when whole; the index lists
    the bundles of the attempt that succeeded, and an attempt that was lost leaves no row in it.
    """
    root = scratch.path("bundles")
    rows = mark_revisits(pages, id_col, payload_col, min_payload_bytes).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        writer, rows_out, made = None, [], 0

        def start():
            name = f"bundle-{part:06d}-{made:04d}-{attempt}.warc.zst"
            return BundleWriter(fs.open_output_stream(f"{base}/.{name}.part"), name, frame_size, level)

        def finish(w):
            out = list(w.close())
            fs.move(f"{base}/.{w.name}.part", f"{base}/{w.name}")
            return out

        nth = 0
        for b in batches:
            ids, urls, payloads, refs = (b.column(i) for i in range(4))
            for i in range(b.num_rows):
                if writer is None:
                    writer = start()
                urn, rec = warc_record(ids[i].as_py(), urls[i].as_py(), (payloads[i].as_py() or "").encode(), refs[i].as_py(), f"{part}-{nth}")
                nth += 1
                rows_out += writer.add(urn, rec)
                if writer.at >= bundle_size:
                    rows_out += finish(writer)
                    writer, made = None, made + 1
            if rows_out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_out)], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")]).cast(arrow_index)
                rows_out = []
        if writer is not None:
            rows_out += finish(writer)
        if rows_out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_out)], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")]).cast(arrow_index)

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    arrow_index = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in INDEX_SCHEMA.split(", ")])
    return scratch.write(rows.mapInArrow(write, INDEX_SCHEMA), "index")


def read_archive(index: DataFrame, scratch: Scratch, with_payload: bool = False) -> DataFrame:
    """Read the indexed records back: one ranged read per frame, records cut at their offsets and checked."""
    root = scratch.path("bundles")
    # tasks are cut by the bytes to decompress, not by the few bytes that name them
    size = index.agg(F.sum("record_bytes").alias("n")).first()["n"] or 0
    tasks = max(1, -(-size // TASK_BYTES))
    frames = index.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame").agg(F.first("frame_start").alias("frame_start"), F.first("frame_bytes").alias("frame_bytes"), F.first("frame_size").alias("frame_size"), F.collect_list(F.struct("record_offset", "record_bytes", "record_id")).alias("records"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            last, f, table = None, None, []
            order = sorted(range(b.num_rows), key=lambda i: (b.column(0)[i].as_py(), b.column(1)[i].as_py()))
            for i in order:
                name, frame, start, size, full, records = (b.column(k)[i].as_py() for k in range(6))
                if name != last:
                    f, last = fs.open_input_file(f"{base}/{name}"), name
                    table = read_seek_table(f)
                if table[frame] != (start, size):
                    raise ValueError(f"{name}: the seek table and the index differ at frame {frame}")
                raw = unpack.decompress(f.read_at(size, start), max_output_size=full)
                out = []
                for r in records:
                    rec = parse_record(raw[r["record_offset"] : r["record_offset"] + r["record_bytes"]])
                    head = rec["head"]
                    if head["WARC-Record-ID"] != r["record_id"]:
                        raise ValueError(f"{name}: another record at the offset of {r['record_id']}")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(rec["payload"]).digest()).decode() != digest:
                        raise ValueError(f"{r['record_id']}: payload and digest differ")
                    rid, ref = head["WARC-Record-ID"][12:-1], head.get("WARC-Refers-To")
                    out.append((None if rid.startswith("null-") else int(rid), rec["payload"] if with_payload else None, int(rec["http"]["Content-Length"]), digest, head["WARC-Type"], int(ref[12:-1]) if ref else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    return frames.mapInArrow(read, RECORD_SCHEMA)


def op1_warc_bundles(spark, sf_dir: str) -> DataFrame:
    """Archive every page, read the archive back, and report what the records say."""
    scratch = Scratch(spark, "warc")
    index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)
    return read_archive(index, scratch).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS s FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS top FROM h),
d AS (
  SELECT page_id, n, s, top, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr(s, 5 * (k // 4) + 1, 5))::BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1), '' ORDER BY k) AS b32
  FROM g, range(32) r(k) GROUP BY page_id, n, s, top
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""
