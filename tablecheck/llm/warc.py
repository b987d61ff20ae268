"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with several whole records, followed by a seek table
in a skippable frame (compressed and plain size per frame, number of frames, magic number), so a reader needs
only the bundle's end and one frame to reach a record. The index maps a record's id to bundle, frame, and offset
and length inside the plain frame.

Bundles are stored as rows with a binary column: Spark's writers commit them, so lost executors and repeated
tasks leave no halves behind, and every store that Spark reaches will do. ``export`` makes files of them.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.session import ship_by_value

ship_by_value(__name__)

#: Plain bytes after which a frame, and a bundle, is closed; a larger record makes a larger frame.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 24
#: Fixed values of the seekable format: skippable frame magic, seek table magic.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLE_SCHEMA = "bundle string, content binary, records array<struct<record_id: bigint, frame: int, offset: bigint, length: bigint>>"
RECORD_SCHEMA = "record_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``df`` (record_id, url, payload) with ``refers_to``: the largest id among records of equal payload of at
    least ``min_bytes`` bytes, null on that record itself.

    A null payload is an empty one. A null id is smaller than any other; records that repeat the largest id
    are all responses. Payloads are equal when length and SHA-256 are. Only the largest ids of payloads that occur twice
    are joined; AQE splits a payload that holds many records, as the join's other side has one row for it.
    """
    rows = df.select("record_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256)).withColumn("bytes", F.length("payload").cast("long"))
    heads = rows.filter(F.col("bytes") >= min_bytes).groupBy("same", "bytes").agg(F.max("record_id").alias("head"), F.count(F.lit(1)).alias("n"))
    marked = rows.join(heads.filter("n > 1").drop("n"), ["same", "bytes"], "left")
    return marked.select("record_id", "url", "payload", F.when(~F.col("record_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))


def render(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; line ends in an address are percent-encoded, a null id or address has no header."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if record_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{record_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Payload-Length: {len(payload)}"]
    block = payload if refers_to is None else b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(head["Content-Length"])
    number = lambda name: int(head[name].removeprefix("<urn:page:").rstrip(">")) if name in head else None
    url = head.get("WARC-Target-URI")
    payload, said = data[start : start + size], head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and payload_digest(payload) != said:
        raise ValueError(f"payload of record {head.get('WARC-Record-ID')} does not match its digest")
    record = {
        "record_id": number("WARC-Record-ID"),
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": head["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload_bytes": int(head["WARC-Payload-Length"]) if revisit else size,
        "payload_digest": said,
        "payload": None if revisit else payload,
    }
    return record, start + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *pair) for pair in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and plain size of every frame, from the bundle's last bytes."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    entries = bundle[-9 - 8 * count : -9]
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", entries):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


def read_record(bundle: bytes, frame: int, offset: int) -> dict:
    """Random access: one frame is decompressed, nothing before it."""
    return parse(read_frame(bundle, frames(bundle)[frame]), offset)[0]


def bundles(marked: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles of the records of ``mark_revisits``: bundle (name), content, records (the index entries).

    A worker holds one bundle at a time. No records, no bundles. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3)
        packed: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        entries: list[dict] = []
        open_frame = bytearray()
        total = 0

        def close_frame() -> None:
            if open_frame:
                packed.append(squeeze.compress(bytes(open_frame)))
                sizes.append((len(packed[-1]), len(open_frame)))
                open_frame.clear()

        def close_bundle() -> pa.RecordBatch:
            nonlocal number, total
            close_frame()
            row = {"bundle": f"{part:06d}-{number:06d}.warc.zst", "content": b"".join(packed) + seek_table(sizes), "records": list(entries)}
            packed.clear(), sizes.clear(), entries.clear()
            number, total = number + 1, 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        entry = pa.struct([("record_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
        schema = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("records", pa.list_(entry))])
        for batch in batches:
            for values in zip(*(batch.column(c) for c in ("record_id", "url", "payload", "refers_to")), strict=True):
                record_id, url, payload, refers_to = (v.as_py() for v in values)
                record = render(record_id, url, payload, refers_to)
                entries.append({"record_id": record_id, "frame": len(sizes), "offset": len(open_frame), "length": len(record)})
                open_frame += record
                total += len(record)
                if len(open_frame) >= frame_bytes:
                    close_frame()
                if total >= bundle_bytes:
                    yield close_bundle()
        if entries:
            yield close_bundle()

    return marked.select("record_id", "url", "payload", "refers_to").mapInArrow(run, BUNDLE_SCHEMA)


def index(stored: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset, length."""
    return stored.select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def read(stored: DataFrame) -> DataFrame:
    """Every record of stored bundles, frame by frame; a response whose payload is not as its digest says is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        schema = pa.schema([*types, ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for cell in batch.column("content"):
                content = cell.as_py()
                for frame in frames(content):
                    plain, at, records = read_frame(content, frame), 0, []
                    while at < len(plain):
                        record, at = parse(plain, at)
                        records.append(record)
                    yield pa.RecordBatch.from_pylist(records, schema=schema)

    return stored.select("content").mapInArrow(run, RECORD_SCHEMA)


def export(stored: DataFrame, folder: str) -> None:
    """Writes each bundle to a file below ``folder``, a path mounted on every executor; a repeated task overwrites its own files."""

    def run(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            partial = os.path.join(folder, f".{row.bundle}.{TaskContext.get().taskAttemptId()}")
            with open(partial, "wb") as out:
                out.write(row.content)
            os.replace(partial, os.path.join(folder, row.bundle))

    stored.select("bundle", "content").foreachPartition(run)
