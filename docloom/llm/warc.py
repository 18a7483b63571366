"""WARC archives in seekable Zstandard bundles.

A record is serialised as WARC/1.1 and several records form one independent Zstandard frame of about ``frame_bytes``.
A bundle is a file of frames with a footer: a skippable frame that holds the public seek-table format (compressed and
decompressed size of each frame, frame count, magic). The index names, for every record, bundle, frame and the offset
inside the frame's content, so one record costs one seek and one frame. Equal payloads of at least ``min_revisit``
bytes are stored once: the largest page_id is the response, the others are revisit records, which hold the HTTP head
but no body.

Every task writes bundles under names of its own and reports them; only what successful tasks report is read, so lost
and repeated tasks do no harm. Files go to the shared folder through pyarrow's file systems.

Null html is an empty payload. A null or empty url stands as ``urn:page:<page_id>``. Rows with a null page_id are
responses of their own and revisit nothing. Rows that repeat the responding page_id with the same payload are responses
too. Columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, shared_dir, utf8

MIN_REVISIT = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
#: Rows (a digest, an id, a url) of repeated payloads that may be broadcast.
MAX_GROUPS = 200_000
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
SEEK_FOOTER = struct.Struct("<IBI")


def record_bytes(record_id: str, date: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None, refers_to_url: str | None = None) -> bytes:
    """One WARC record of a page: a response, or, with ``refers_to``, a revisit of that page's equal payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"),
        f"WARC-Record-ID: <urn:uuid:{record_id}>".encode(),
        f"WARC-Date: {date}".encode(),
        b"WARC-Target-URI: " + _uri(url, page_id),
        f"WARC-Payload-Digest: sha1:{digest}".encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}".encode())
    if refers_to is not None:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To-Target-URI: " + _uri(refers_to_url, refers_to),
            f"WARC-Refers-To-Date: {date}".encode(),
            f"X-Refers-To-Page: {refers_to}".encode(),
        ]
    return b"\r\n".join([*head, f"Content-Length: {len(block)}".encode(), b"", b""]) + block + b"\r\n\r\n"


def _uri(url: str | None, page_id) -> bytes:
    text = url or f"urn:page:{'' if page_id is None else page_id}"
    return text.encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def payload_of(block: bytes) -> tuple[int, bytes]:
    """The length that the HTTP head of a block tells, and what follows the head."""
    head, _, body = block.partition(b"\r\n\r\n")
    length = next(line for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return int(length.split(b":")[1]), body


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), body and the place after the record."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.decode().lower(): v.decode("utf-8", "surrogatepass") for k, v in (line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in lines[1:])}
    n = int(headers["content-length"])
    return headers, data[end + 4 : end + 4 + n], end + 4 + n + 4


class BundleWriter:
    """Frames into one file; ``close`` appends the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table: list[tuple[int, int]] = []
        self.pending, self.size, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame's content) of the record."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self.flush()
        place = (len(self.table), self.size)
        self.pending.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.packer.compress(b"".join(self.pending))
            self.out.write(packed)
            self.table.append((len(packed), self.size))
            self.written += len(packed)
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", c, d) for c, d in self.table) + SEEK_FOOTER.pack(len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries)) + entries)
        self.out.close()


class BundleReader:
    def __init__(self, file):
        self.file = file
        size = file.size()
        frames, flags, magic = SEEK_FOOTER.unpack(self.at(size - SEEK_FOOTER.size, SEEK_FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError("not a seekable bundle of this layout")
        table = self.at(size - SEEK_FOOTER.size - 8 * frames, 8 * frames)
        self.frames, start = [], 0
        for packed, content in struct.iter_unpack("<II", table):
            self.frames.append((start, packed, content))
            start += packed

    def at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        start, packed, content = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.at(start, packed), max_output_size=content)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse_record(self.frame(frame), offset)[:2]


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT, max_groups: int = MAX_GROUPS) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to, refers_to_url.

    Only (digest, id, url) are grouped, with partial aggregation. One row for each payload that repeats then meets the
    pages by digest: broadcast up to ``max_groups`` such rows (counted first), so that payloads stay where they are,
    else by a plain join, in which adaptive execution can split a payload of many copies.
    """
    rows = pages.select("page_id", "url", F.coalesce(utf8("html"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_ = rows.filter((F.octet_length("payload") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    groups = long_.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.min("page_id").alias("least"), F.max(F.struct("page_id", "url"))["url"].alias("response_url"))
    groups = cut_lineage(groups.filter(F.col("least") < F.col("response_id")).drop("least"))
    out = rows.join(F.broadcast(groups) if groups.count() <= max_groups else groups, "digest", "left")
    revisit = F.col("page_id") < F.col("response_id")
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("response_id")).alias("refers_to"), F.when(revisit, F.col("response_url")).alias("refers_to_url"))


INDEX = "page_id bigint, path string, frame int, offset bigint"


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str | None = None, **options) -> DataFrame:
    """Writes the bundles and returns the index (page_id, path, frame, offset), checkpointed: writing happens once.

    ``date`` (UTC, as 2024-01-31T12:00:00Z) is every record's date; the time of the call, if not given. Record ids are
    made from a record's bundle and place, so no two are alike.
    """
    rows = with_roles(pages, min_revisit, **options)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        bundle = name = None
        n = 0
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if bundle is None or bundle.written >= bundle_bytes:
                    if bundle is not None:
                        bundle.close()
                    name, n = uuid.uuid4(), 0
                    path = f"{root}/{name.hex}.warc.zst"
                    bundle = BundleWriter(fs.open_output_stream(path, compression=None), frame_bytes)
                record = record_bytes(str(uuid.uuid5(name, str(n))), date, r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["refers_to_url"])
                n += 1
                index.append((r["page_id"], path, *bundle.add(record)))
            ids, paths, frames, offsets = zip(*index) if index else ((), (), (), ())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64())], ["page_id", "path", "frame", "offset"])
        if bundle is not None:
            bundle.close()

    return cut_lineage(rows.mapInArrow(write, INDEX))


RECORD = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The record at each place that the index names; a frame's records are read by one task, the frame unpacked once.

    The digest of a response is taken from its bytes as read and must equal the stored one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(folder)
        path = reader = frame = data = None
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, reader, frame = r["path"], BundleReader(fs.open_input_file(r["path"])), None
                if r["frame"] != frame:
                    frame, data = r["frame"], reader.frame(r["frame"])
                h, block, _ = parse_record(data, r["offset"])
                stored = h["warc-payload-digest"].removeprefix("sha1:")
                size, body = payload_of(block)
                response = h["warc-type"] == "response"
                if _number(h.get("x-page-id")) != r["page_id"] or (response and hashlib.sha1(body).hexdigest() != stored):
                    raise ValueError(f"record {h['warc-record-id']} is damaged or not where the index says")
                out.append((r["page_id"], h["warc-target-uri"], h["warc-type"], stored, size, _number(h.get("x-refers-to-page")), body if payloads and response else None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names)

    places = index.select("page_id", "path", "frame", "offset")
    return places.repartition("path", "frame").sortWithinPartitions("path", "frame", "offset").mapInArrow(read, RECORD)


def archive_round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` to a new folder of the shared one and reads them back, without the payloads."""
    folder = folder or os.path.join(shared_dir(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    return read_archives(write_archives(pages, folder, **options), folder, payloads=False)
