"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress independently; a bundle ends with a skippable
frame that lists the frames' sizes (the seekable format), and an index maps each record to its
bundle, frame and place within the frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import shared_dir, small_batches, stage_table, utf8_rows

#: Bytes of records in a frame, and of frames in a bundle, after which the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, record_id string, bundle string, frame int, frame_at long, frame_bytes long, at long, record_bytes long"
_INDEX_NAMES = [part.split()[0] for part in INDEX.split(", ")]


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def page_of(urn: str) -> int | None:
    last = urn.rpartition(":")[2]
    return None if last == "none" else int(last)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record. A revisit has no block; its headers keep the payload's digest and size."""
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Identified-Payload-Length", str(size)),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", "0" if revisit else str(len(payload))),
    ]
    if url is not None:
        head.insert(2, ("WARC-Target-URI", "".join(url.splitlines())))
    if revisit:
        head.insert(3, ("WARC-Refers-To", f"<{record_id(refers_to)}>"))
        head.insert(4, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + (b"" if revisit else payload) + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; an error if it is not whole."""
    head, found, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if version != "WARC/1.1" or not found or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {headers.get('WARC-Record-ID')}")
    return headers, rest[:size]


@dataclass
class BundleWriter:
    """Writes records to frames and closes the bundle with its seek table."""

    path: str
    level: int = LEVEL
    frame_bytes: int = FRAME_BYTES
    frames: list[tuple[int, int]] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(at, compression=None)
        self.packer = zstandard.ZstdCompressor(level=self.level, write_checksum=True)
        self.written = 0
        self.records: list[tuple[int | None, bytes]] = []
        self.held = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.records.append((page_id, record))
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        if not self.records:
            return
        packed = self.packer.compress(b"".join([r for _, r in self.records]))
        at = 0
        for page_id, record in self.records:
            self.rows.append((page_id, record_id(page_id), self.path, len(self.frames), self.written, len(packed), at, len(record)))
            at += len(record)
        self.frames.append((len(packed), self.held))
        self.out.write(packed)
        self.written += len(packed)
        self.records, self.held = [], 0

    def close(self) -> list[tuple]:
        """Write the seek table; the index rows of all records."""
        self._end_frame()
        table = b"".join([struct.pack("<II", *sizes) for sizes in self.frames])
        footer = table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(footer)) + footer)
        self.out.close()
        return self.rows


class BundleReader:
    """Frames of a bundle by number, found through its seek table."""

    def __init__(self, path: str):
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError(f"{path} has no seek table")
        head = 9 + 8 * n
        kind, length = struct.unpack("<II", self.file.read_at(8, size - head - 8))
        if kind != SKIPPABLE_MAGIC or length != head:
            raise ValueError(f"the seek table of {path} is broken")
        self.frames, start = [], 0
        for packed, plain in struct.iter_unpack("<II", self.file.read_at(8 * n, size - head)):
            self.frames.append((start, packed, plain))
            start += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return self.unpacker.decompress(self.file.read_at(packed, at), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_INDEX_NAMES)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html) to (page_id, url, sha, size, the payload compressed for the shuffle)."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        payloads = [p or b"" for p in utf8_rows(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([hashlib.sha1(p).hexdigest() for p in payloads], pa.string()),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([packer.compress(p) for p in payloads], pa.binary()),
            ],
            names=["page_id", "url", "sha", "size", "packed"],
        )


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html",
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write a record per page into bundles under ``folder``; the index, one row per record.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id
    is a response, and so is a repeated row of it; the others revisit it. A null html is an empty
    payload. A null page_id is never the largest; pages that all lack one are all responses.
    Other columns are ignored. A task writes bundles with names of its own and the index names
    only those of the attempt that counts, so a repeated attempt leaves a file that nothing reads.
    Payloads cross the one shuffle (by digest, in written tables, so that Spark splits a digest
    that many pages share) compressed.
    """
    small_batches(pages.sparkSession)
    schema = "page_id long, url string, sha string, size long, packed binary"
    made = pages.select(F.col(page_id).cast("long"), F.col(url), F.col(html)).mapInArrow(_packed, schema)
    payload = F.coalesce(F.col(html), F.lit(""))
    digests = pages.select(F.col(page_id).cast("long").alias("id"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).cast("long").alias("n"))
    shared = digests.groupBy("sha", "n").agg(F.max("id").alias("first"), F.count("*").alias("copies"))
    shared = stage_table(shared.where((F.col("copies") > 1) & (F.col("n") >= min_bytes)).drop("copies"), "shared-payloads")
    told = made.join(shared, (made["sha"] == shared["sha"]) & (made["size"] == shared["n"]), "left")
    told = told.select("page_id", "url", made["sha"], "size", "packed", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        writer = None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                page, link, sha, size, packed, first = row
                if writer is None:
                    writer = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes=frame_bytes)
                revisit = first is not None and page != first
                payload = b"" if revisit else unpacker.decompress(packed)
                writer.add(page, warc_record(page, link, payload, base32(bytes.fromhex(sha)), size, first, revisit))
                if writer.written >= bundle_bytes:
                    yield _index_batch(writer.close())
                    writer = None
        if writer is not None:
            yield _index_batch(writer.close())

    return stage_table(told.mapInArrow(write, INDEX), "warc-index")


RECORDS = "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names, each read from its frame and checked.

    Each partition of the index reads a frame once for the rows that follow each other in it. A
    response's payload must have the digest that its header states. A revisit's digest and size
    are those of its headers, its payload is null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, number, reader, frame = None, None, None, b""
        for batch in batches:
            rows: list[tuple] = []
            for want in batch.to_pylist():
                if want["bundle"] != path:
                    if reader is not None:
                        reader.close()
                    path, number, reader = want["bundle"], None, BundleReader(want["bundle"])
                if want["frame"] != number:
                    number = want["frame"]
                    frame = reader.frame(number)
                headers, block = parse_record(frame[want["at"] : want["at"] + want["record_bytes"]])
                kind = headers["WARC-Type"]
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Identified-Payload-Length"])
                if kind == "response" and (base32(hashlib.sha1(block).digest()), len(block)) != (digest, size):
                    raise ValueError(f"the payload of {want['record_id']} is broken")
                to = headers.get("WARC-Refers-To")
                found = headers["WARC-Record-ID"].strip("<>")
                rows.append((page_of(found), found, size, digest, kind, page_of(to.strip("<>")) if to else None, headers.get("WARC-Target-URI"), block if payloads and kind == "response" else None))
                if len(rows) == 1000:
                    yield _record_batch(rows)
                    rows = []
            if rows:
                yield _record_batch(rows)
        if reader is not None:
            reader.close()

    return index.mapInArrow(read, RECORDS)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [part.split()[0] for part in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for bundles in the shared folder, with the scheme that Spark reads it by."""
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}")
    named = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", named)
