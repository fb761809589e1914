"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each some whole WARC records, and a seek table in
a skippable frame at its end (the public seekable format: sizes of each frame, their number, magic).
An index maps each record to its frame and its offset in the decompressed frame, so one record is
read by decompressing one frame. Bundles are rows of a table in the shared folder, written and read
by Spark itself, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import parts_of, pick, saved

# fixed values: the seekable format's numbers
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Records go into a frame up to so many bytes, frames into a bundle; a larger record is alone.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None, digest: str, place: str = "") -> str:
    """The identifier of a page's response to that payload; with a place, of the record there."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, place: str = "") -> bytes:
    """One WARC/1.1 record; a revisit has the digest and size of its payload but not the payload."""
    digest = payload_digest(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_name(page_id, digest, place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\n\r\n"
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_name(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    else:
        body += payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, content block and end of the record at an offset."""
    data = bytes(data) if isinstance(data, memoryview) else data
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    start = end + 4
    stop = start + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    return head, data[start:stop], stop + 4


class BundleWriter:
    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.total = 0
        self.index: list[tuple[str, int | None, int, int]] = []  # record's name, page_id, frame, offset in it

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.filled and self.filled + len(data) > FRAME_BYTES:
            self.end_frame()
        name = data[data.index(b"WARC-Record-ID: ") + 16 :].split(b"\r\n", 1)[0].decode()
        self.index.append((name, page_id, len(self.frames), self.filled))
        self.open.append(data)
        self.filled += len(data)
        self.total += len(data)

    def end_frame(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.sizes.append((len(frame), self.filled))
            self.frames.append(frame)
            self.open, self.filled = [], 0

    def close(self) -> bytes:
        self.end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


class BundleReader:
    """Frames of a bundle by number, found from the seek table at its end."""

    def __init__(self, data: bytes):
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE or flags & 0x80:
            raise ValueError("no seek table that this reads")
        entries = struct.iter_unpack("<II", data[-9 - 8 * n : -9])
        self.data, self.at, self.sizes = data, [0], []
        for packed, plain in entries:
            self.at.append(self.at[-1] + packed)
            self.sizes.append(plain)
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, k: int) -> bytes:
        out = self.decompressor.decompress(self.data[self.at[k] : self.at[k + 1]], max_output_size=self.sizes[k])
        if len(out) != self.sizes[k]:
            raise ValueError(f"frame {k} has {len(out)} bytes")
        return out


_BUNDLES = "bundle binary, records array<struct<record_id: string, page_id: long, frame: int, offset: long>>"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html, known, run: bundles of records. A response that others may refer to is named
    by its page and payload, any other record by where it was written."""
    kind = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64())]))
    part, count = TaskContext.get().partitionId(), 0

    def done(w: BundleWriter) -> pa.RecordBatch:
        data = w.close()
        index = [{"record_id": r, "page_id": p, "frame": f, "offset": o} for r, p, f, o in w.index]
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([index], kind)], ["bundle", "records"])

    writer = BundleWriter()
    for batch in parts_of(batches, "html", 4 << 20):
        for page_id, url, html, known, run in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            revisit = known is not None and page_id != known
            place = "" if page_id is not None and page_id == known else f"{run}:{part}:{count}"
            writer.add(page_id, record(page_id, url, (html or "").encode(), known if revisit else None, revisit, place))
            count += 1
            if writer.total >= BUNDLE_BYTES:
                yield done(writer)
                writer = BundleWriter()
    if writer.index:
        yield done(writer)


def write_bundles(pages: DataFrame, least: int = 0) -> DataFrame:
    """A table of bundles, written to the shared folder, of pages (page_id, url, html): bundle
    binary, records array of (record_id, page_id, frame, offset).

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is
    the response and others revisit it; rows that share that page_id are all responses, and so is
    a payload none of whose rows has a page_id. A row without page_id revisits one that has. Records
    have identifiers of their own, but for rows of equal page_id and payload that others revisit.

    A common payload's rows meet in a join with one row, whose other side is written: such a
    partition can be split.
    """
    pages = pick(pages, page_id="long", url="string", html="string")
    pages = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    known = saved(
        pages.where(long).groupBy("digest").agg(F.max("page_id").alias("known"), F.count("*").alias("n")).where("n > 1 and known is not null")
        .select("digest", "known"),
        "known",
    )
    rows = pages.join(known, "digest", "left")
    run = F.lit(uuid.uuid4().hex).alias("run")
    return saved(rows.select("page_id", "url", "html", F.when(long, F.col("known")).alias("known"), run).mapInArrow(_write, _BUNDLES), "warc")


def read_bundles(bundles: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of a table of bundles, each found by its frame and offset: page_id,
    payload_bytes long, payload_digest string, record_type string, refers_to long; with
    ``payloads`` also payload binary (null for revisits). A response whose payload differs from its
    digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, number, frame = BundleReader(data), -1, b""
                rows: list[tuple] = []
                for x in index:
                    if x["frame"] != number:
                        number = x["frame"]
                        frame = reader.frame(number)
                    head, block, _ = parse_record(frame, x["offset"])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload, refers = None, None
                    if head["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if payload_digest(payload) != digest or len(payload) != int(head["X-Payload-Length"]):
                            raise ValueError(f"page {x['page_id']} is damaged")
                    else:
                        refers = int(head["X-Refers-To-Page-ID"])
                        if head["WARC-Refers-To"] != record_name(refers, digest):
                            raise ValueError(f"page {x['page_id']} refers to no record of page {refers}")
                    own = int(head["X-Page-ID"]) if head["X-Page-ID"] else None
                    if (own, head["WARC-Record-ID"]) != (x["page_id"], x["record_id"]):
                        raise ValueError(f"the index names {x['page_id']}, the record {own}")
                    rows.append((own, int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers, payload))
                own, size, digest, kind, refers, payload = zip(*rows, strict=True)
                columns = [pa.array(own, pa.int64()), pa.array(size, pa.int64()), pa.array(digest), pa.array(kind), pa.array(refers, pa.int64())]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if payloads:
                    columns.append(pa.array(payload, pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return bundles.select("bundle", "records").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, least: int = 0, payloads: bool = False) -> DataFrame:
    """Writes pages (page_id, url, html) as bundles and reads these: one row per page, as
    read_bundles. Null html is an empty payload; a null url is about:blank; whole pages are stored;
    other columns are left behind; an empty table gives an empty result."""
    return read_bundles(write_bundles(pages, least), payloads)
