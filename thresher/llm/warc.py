"""WARC archives: one gzip member per record, written by tasks, read sequentially."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thresher.llm.common import BROADCAST_BYTES
from thresher.session import bounded, materialize, scratch_dir

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 18
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"
MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, offset long, record_type string, record_id string, refers_to string, target_uri string,"
    " payload_bytes long, payload_digest string, payload binary"
)


class WarcError(ValueError):
    """A record whose framing or digest is wrong."""


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(fields: list[tuple[str, str]]) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in fields]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit (``refers_to`` given) holds no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{PAGE_URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", sha1_label(payload)),
        ("WARC-Block-Digest", sha1_label(block)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%-._~")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{PAGE_URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    packer = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return packer.compress(_header(fields) + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    offset: int
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def _member(stream: BinaryIO, ahead: bytes) -> tuple[bytes, bytes, int]:
    """Decompress one gzip member chunk by chunk: its data, what follows, bytes used."""
    unpacker, parts, used = zlib.decompressobj(16 + zlib.MAX_WBITS), [], 0
    while not unpacker.eof:
        ahead = ahead or stream.read(CHUNK)
        if not ahead:
            raise WarcError("archive ends inside a gzip member")
        try:
            parts.append(unpacker.decompress(ahead))
        except zlib.error as error:
            raise WarcError(f"not a gzip member: {error}") from error
        used, ahead = used + len(ahead), b""
    return b"".join(parts), unpacker.unused_data, used - len(unpacker.unused_data)


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """Records of an archive in order; memory is bounded by the largest record.

    Checks the version line, the content length against the member and the block
    digest; raises ``WarcError`` at the first record that breaks a rule.
    """
    offset, ahead = 0, b""
    while ahead := ahead or stream.read(CHUNK):
        data, ahead, used = _member(stream, ahead)
        head, split, body = data.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not split or not lines[0].startswith(b"WARC/"):
            raise WarcError(f"no record header at {offset}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError) as error:
            raise WarcError(f"no content length at {offset}") from error
        if body[length:] != b"\r\n\r\n":
            raise WarcError(f"content length does not frame the record at {offset}")
        found = Record(offset, fields, body[:length])
        if "warc-block-digest" in fields and fields["warc-block-digest"] != sha1_label(found.block):
            raise WarcError(f"block digest differs at {offset}")
        yield found
        offset += used


def payload_of(found: Record) -> tuple[bytes, int]:
    """The payload after the HTTP header, and its full length as that header states.

    A response is checked against its payload digest and stated length.
    """
    head, _, payload = found.block.partition(b"\r\n\r\n")
    stated = [x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    length = int(stated[0]) if stated else len(payload)
    if found.fields.get("warc-type") == "response":
        if length != len(payload) or found.fields.get("warc-payload-digest") != sha1_label(payload):
            raise WarcError(f"payload digest or length differs at {found.offset}")
    return payload, length


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads of 1000 bytes or more, all
    but the row with the largest page_id refer to it.

    Payloads are grouped by SHA-1 and length with partial sums, so a payload that a
    third of the pages share is reduced before the shuffle. Only payloads that occur
    twice are joined back: broadcast if measured small, else by a join that splits
    skewed keys. Rows repeating the largest page_id are all responses. Rows without a
    page_id never are the target; if no member has one, all are responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    size = F.octet_length("html")
    digest = F.when(size >= REVISIT_BYTES, F.sha1(F.col("html").cast("binary")))
    repeated = (
        rows.select("page_id", digest.alias("digest"))
        .filter("digest is not null")
        .groupBy("digest")
        .agg(F.count("*").alias("rows"), F.max("page_id").alias("target"))
        .filter("rows > 1 and target is not null")
        .select("digest", "target")
    )
    repeated = materialize(repeated, "repeated")
    if bounded(repeated, ["digest"], BROADCAST_BYTES):
        repeated = F.broadcast(repeated)
    joined = rows.withColumn("digest", F.coalesce(digest, F.lit(""))).join(repeated, "digest", "left")
    other = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("target")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write marked pages below ``folder``; returns the manifest of the finished files.

    Each task writes files of about ``archive_bytes`` under names of its own attempt, so
    a repeated task never touches another's file, and only files of attempts that
    succeeded are in the manifest. ``folder`` is one that all executors reach.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        sink, path, records, size = None, "", 0, 0
        done: dict[str, list] = {"path": [], "records": [], "bytes": []}

        def close() -> None:
            sink.close()
            for name, value in zip(done, (path, records, size)):
                done[name].append(value)

        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    path, records, size = f"{folder}/{name}", 0, 0
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)
                data = record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"])
                sink.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        yield pa.record_batch(done, schema=schema)

    return materialize(pages.mapInArrow(write, MANIFEST), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the manifest's archives, read one after another in a task.

    ``payload_digest`` is bare lower-case hex. ``payload`` is null for revisits, or
    for all records without ``payloads``. An archive that does not hold the manifest's
    number of records (cut at the border of a member, say) raises ``WarcError``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds)))
        for batch in batches:
            for path, records in zip(batch["path"].to_pylist(), batch["records"].to_pylist()):
                system, name = _open(path)
                with system.open_input_stream(name, compression=None) as stream:
                    rows, held, read_so_far = [], 0, 0
                    for found in read_records(stream):
                        payload, length = payload_of(found)
                        kind, f = found.fields.get("warc-type"), found.fields
                        label = f.get("warc-payload-digest", "sha1:").removeprefix("sha1:")
                        kept = payload if payloads and kind == "response" else None
                        rows.append((path, found.offset, kind, f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), length, base64.b32decode(label).hex(), kept))
                        held += len(kept or b"") + 500
                        read_so_far += 1
                        if held > 8 << 20:
                            yield pa.record_batch(list(map(list, zip(*rows))), schema=schema)
                            rows, held = [], 0
                    if read_so_far != records:
                        raise WarcError(f"{path} holds {read_so_far} records, {records} were written")
                    if rows:
                        yield pa.record_batch(list(map(list, zip(*rows))), schema=schema)

    paths = manifest.select("path", "records")
    files = max(1, manifest.count())
    return paths.repartition(min(files, 10_000), "path").mapInArrow(read, RECORDS)


def page_number(urn: str):
    """The page id of ``<urn:page:ID>``; null for an empty one."""
    return F.regexp_extract(urn, f"<{PAGE_URN}(-?\\d+)>", 1).try_cast("long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back: one row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A null html is
    an empty payload; null and repeated page ids, null urls and ties stay rows of their
    own; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    manifest = write_archives(mark_revisits(pages), f"{scratch_dir(spark)}/archives")
    return read_archives(spark, manifest, payloads=False).select(
        page_number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_number("refers_to").alias("refers_to"),
    )
