"""WARC archives in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with a group of whole
WARC records, and a seek table in a skippable frame at the end (the seekable
format: per frame its compressed and plain size, then the number of frames, a
descriptor byte and a magic number).  The index maps a record's identifier to
bundle, frame, and offset and length in the frame's plain bytes, so one record
is read by fetching the seek table and one frame.

Bundles are files in a folder all executors share, under names that no other
attempt of a task uses; only those the index names count, so tasks can be
repeated.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import kernel as K
from .work import Workspace

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
#: The date of records whose capture time is unknown.
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    """A header value without characters that would end it."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page is None else f"<urn:page:{_field(str(page))}>"


def build_record(page, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) has the HTTP header block alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_field(url) if url else 'about:blank'}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    body = http + payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = http
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record; names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload


class BundleWriter:
    """Writes records to one bundle; add() gives a record's frame, offset and length."""

    def __init__(self, fs: pafs.FileSystem, path: str, level: int = 3):
        self.stream = fs.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.plain = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.held and self.held + len(record) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), self.held, len(record)
        self.parts.append(record)
        self.held += len(record)
        self.plain += len(record)
        return place

    def flush(self) -> None:
        if self.parts:
            data = self.zstd.compress(b"".join(self.parts))
            self.stream.write(data)
            self.frames.append((len(data), self.held))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Frames of one bundle by number, found through the seek table."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = np.frombuffer(self.file.read_at(count * 8, size - 9 - count * 8), "<u4").reshape(count, 2).astype(np.int64)
        self.sizes, self.starts = table, np.concatenate([[0], np.cumsum(table[:, 0])])
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        data = self.file.read_at(int(self.sizes[k, 0]), int(self.starts[k]))
        return self.zstd.decompress(data, max_output_size=int(self.sizes[k, 1]))

    def close(self) -> None:
        self.file.close()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = K.raw(batch.column(1))
        data = memoryview(buf)
        digests = [hashlib.sha1(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(digests, pa.binary())], names=["id", "bytes", "sha1"])


INDEX = "bundle string, frame int, start long, length long"


def _write(uri: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        writer, name = None, ""
        for batch in batches:
            ids, urls, refers = (batch.column(k).to_pylist() for k in (0, 1, 3))
            buf, offsets = K.raw(batch.column(2))
            places = []
            for k in range(batch.num_rows):
                if writer is None or writer.plain >= BUNDLE_BYTES:
                    if writer is not None:
                        writer.close()
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs, f"{folder}/{name}")
                places.append((name, *writer.add(build_record(ids[k], urls[k], buf[offsets[k] : offsets[k + 1]].tobytes(), refers[k], date))))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[k] for p in places], t) for k, t in enumerate(kinds))], names=["id", "bundle", "frame", "start", "length"])
        if writer is not None:
            writer.close()

    return run


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(uri)
        reader, name, number, frame = None, None, None, b""
        for batch in batches:
            out = []
            for bundle, k, start, length in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if bundle != name:
                    if reader is not None:
                        reader.close()
                    reader, name, number = BundleReader(fs, f"{folder}/{bundle}"), bundle, None
                if k != number:
                    frame, number = reader.frame(k), k
                fields, http, payload = parse_record(frame[start : start + length])
                kind, mark = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(http["content-length"])
                if kind == "response" and (len(payload) != size or digest(payload) != mark):
                    raise ValueError(f"record {fields['warc-record-id']} of {bundle} is damaged")
                out.append((fields["warc-record-id"], fields["warc-target-uri"], size, mark, kind, fields.get("warc-refers-to"), payload if kind == "response" else None))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            names = ["id", "record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to_id", "payload"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=names)
        if reader is not None:
            reader.close()

    return run


def write_archive(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = DATE, work: Workspace | None = None) -> DataFrame:
    """Writes a record for every row of pages into bundles under uri; the index (id, bundle, frame, start, length).

    Of rows with equal payloads of at least least_bytes bytes, those with the
    least id are responses, the others revisit it; smaller payloads are all
    responses.  Equal payloads are found by SHA-1 and length alone, so payloads
    are shuffled once, to meet their verdict.

    Defined cases: a null payload is empty; a null url is about:blank; a null
    id is always a response, under a random record identifier; rows that share
    an id give a record each, all under the one record identifier of that id; an
    empty table gives no bundle and no rows.  Other columns are ignored.
    """
    spark = pages.sparkSession
    work = work or Workspace(spark)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    kind = base.schema["id"].dataType.simpleString()
    marks = work.keep(base.select("id", "payload").mapInArrow(_digests, f"id {kind}, bytes long, sha1 binary"), "digests")
    marks = marks.filter(f"id is not null and bytes >= {int(least_bytes)}")
    firsts = marks.groupBy("sha1", "bytes").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("sha1", "bytes", "first")
    # rows that share an id may hold different payloads, so the verdict is by id and payload
    again = marks.join(firsts, ["sha1", "bytes"]).filter("id <> first").select("id", "sha1", F.col("first").alias("refers_to")).distinct()
    dealt = base.withColumn("sha1", F.unhex(F.sha1(F.coalesce("payload", F.lit("")))))
    dealt = dealt.join(again, ["id", "sha1"], "left").select("id", "url", "payload", "refers_to")
    return work.keep(dealt.mapInArrow(_write(uri, date), f"id {kind}, {INDEX}"), "index")


def read_archive(index: DataFrame, uri: str) -> DataFrame:
    """(id, record_id, url, payload_bytes, payload_digest, record_type, refers_to_id, payload) of the records that index names.

    Each response's payload is checked against its digest; a revisit's payload
    is null and its size and digest are those of the full payload.

    Defined cases: an index row gives a row, repeated ones as often; a record
    without an id comes under its random identifier, id null; a damaged or
    missing record raises an error; an empty index gives no rows.  Other columns
    of index are ignored.
    """
    kind = index.schema["id"].dataType.simpleString()
    return index.select("id", "bundle", "frame", "start", "length").mapInArrow(_read(uri), f"id {kind}, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to_id string, payload binary")
