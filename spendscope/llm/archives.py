"""Conversion of ARC files, versions 1 and 2, to WARC files, with revisit records for equal payloads.

An ARC record is a header line and as many bytes as the line declares. Version 1 lines hold URL,
IP address, date, media type and length; version 2 adds result code, checksum, location, offset
and file name before the length. A file opens with a record that names its version.

Spark writes and reads the files. A record is a row of a text file whose rows end as WARC records
do, so files are plain or gzipped sequences of records; they are read back by declared lengths
only, never by what payloads hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the header line of a record, by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length"),
}
# WARC records per file; payload bytes after which a task starts a new ARC file, and how many of these are written together.
FILE_RECORDS = 1000
CHUNK_BYTES = 4 << 20
FILE_CHUNKS = 4
_END = "\r\n\r\n"
# What a synthesised record id is derived from: equal input gives equal ids, so a task can run again.
_ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class ArcRecord(NamedTuple):
    version: int
    offset: int
    header: dict[str, str]
    block: bytes


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_line(url: str, date: str, media_type: str, length: int, version: int) -> str:
    """A header line; fields that a version has and the caller doesn't know are "-"."""
    known = {"url": url, "ip": "0.0.0.0", "date": date, "type": media_type, "length": str(length), "result": "200", "offset": "0"}
    return " ".join(re.sub(r"\s", "%20", known.get(f, "-")) or "-" for f in ARC_FIELDS[version])


def arc_opening(name: str, version: int) -> bytes:
    """The record that opens a file: its version, and the names of the fields of later lines."""
    names = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "length": "Archive-length",
             "result": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename"}
    body = f"{version} 0 -\n{' '.join(names[f] for f in ARC_FIELDS[version])}\n".encode()
    line = arc_line(f"filedesc://{name}", "19960101000000", "text/plain", len(body), version)
    return line.encode() + b"\n" + body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its opening one, cut by their declared lengths."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":  # records end with an empty line that no length counts
            at += 1
            continue
        stop = data.index(b"\n", at)
        values = data[at:stop].decode("utf-8", "replace").split(" ")
        length = int(values[-1])
        block = data[stop + 1 : stop + 1 + length]
        if len(block) != length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} are left")
        if version is None:
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS or not values[0].startswith("filedesc:"):
                raise ValueError("not an ARC file of version 1 or 2")
        else:
            fields = ARC_FIELDS[version]
            if len(values) != len(fields):
                raise ValueError(f"record at {at} has {len(values)} fields, version {version} has {len(fields)}")
            yield ArcRecord(version, at, dict(zip(fields, values)), block)
        at = stop + 1 + length


def warc_date(arc_date: str) -> str:
    """The time of an ARC record (up to 14 digits, missing ones as early as can be) as WARC writes it."""
    digits = re.sub(r"\D", "", arc_date)[:14]
    full = digits + "19960101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


def payload_of(record: ArcRecord) -> bytes:
    """The body of an HTTP response, or the whole block of other records."""
    if record.block.startswith(b"HTTP/"):
        return record.block.partition(b"\r\n\r\n")[2]
    return record.block


def warc_record(record: ArcRecord, record_id: str, refers_to: tuple[str, str, str] | None) -> bytes:
    """A response, or a revisit of the (id, URI, date) ``refers_to``, without the end of the record."""
    http = record.block.startswith(b"HTTP/")
    payload = payload_of(record)
    head = record.block[: len(record.block) - len(payload)]
    block = record.block if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {warc_date(record.header['date'])}",
        f"WARC-Target-URI: {record.header['url']}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Type: {'application/http;msgtype=response' if http else record.header['type']}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{refers_to[0]}>",
            f"WARC-Refers-To-Target-URI: {refers_to[1]}",
            f"WARC-Refers-To-Date: {refers_to[2]}",
            f"X-Payload-Length: {len(payload)}",
        ]
    return ("\r\n".join(lines) + _END).encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record, cut by Content-Length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + length]
        if len(block) != length or data[stop + 4 + length : stop + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"record at {at} declares {length} bytes that it doesn't have")
        yield headers, block
        at = stop + 8 + length


def write_archive(records: DataFrame, folder: str, end: str = _END, most: int = FILE_RECORDS) -> None:
    """Rows of one string (or binary) column as files of records, gzipped, ``most`` of them in each at most."""
    name = records.columns[0]
    writer = records.select(F.col(name).cast("string").alias("value")).write
    # The fastest level takes a third of the time of the default one, and a few parts in a hundred more room.
    writer = writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("lineSep", end).option("maxRecordsPerFile", most).text(folder)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files of an archive folder, still compressed."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return found.select("path", "content")


def _plain(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:  # one member or one for each record
        inflate = zlib.decompressobj(31)
        parts.append(inflate.decompress(content))
        content = inflate.unused_data
    return b"".join(parts)


def _arc_chunks(batches: Iterable[pa.RecordBatch], version: int, http: bool) -> Iterator[pa.RecordBatch]:
    """Rows (number, url, date, payload) as ARC files of about CHUNK_BYTES."""
    task, files = TaskContext.get().partitionId(), 0
    held: list[bytes] = []
    size = 0

    def closed() -> pa.RecordBatch:
        opening = arc_opening(f"{task}-{files}.arc", version)
        return pa.RecordBatch.from_arrays([pa.array([opening + b"".join(held)], pa.binary())], ["file"])

    for batch in batches:
        numbers, urls, dates = (batch.column(c).to_pylist() for c in ("number", "url", "date"))
        payloads = batch.column("payload").cast(pa.binary()).to_pylist()
        for number, url, date, payload in zip(numbers, urls, dates, payloads):
            block = payload or b""
            if http:
                head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\nX-Page: {'' if number is None else number}\r\n\r\n"
                block = head.encode() + block
            line = arc_line(url or "-", date or "-", "text/html", len(block), version)
            held.append(line.encode() + b"\n" + block + b"\n")
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield closed()
                held, size, files = [], 0, files + 1
    if held:
        yield closed()


def arc_files(pages: DataFrame, version: int) -> DataFrame:
    """Rows (number, url, date, payload) as rows of one binary column ``file``, an ARC file each."""
    rows = pages.select("number", "url", "date", "payload")
    return rows.mapInArrow(partial(_arc_chunks, version=version, http=True), "file binary")


_CONVERTED = "record_id string, number long, uri string, date string, digest string, payload_bytes long, arc binary"


def _arc_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) as records with synthesised identifiers, times and digests."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[dict] = []
            size = 0
            for at, record in enumerate(record for file in _files(_plain(content)) for record in parse_arc(file)):
                payload = payload_of(record)
                page = re.match(rb"HTTP/[^\r]*(?:\r\n[^\r]+)*?\r\nX-Page: (-?\d+)\r\n", record.block)
                rows.append(
                    {
                        "record_id": str(uuid.uuid5(_ID_SPACE, f"{path.rpartition('/')[2]}#{at}")),
                        "number": int(page[1]) if page else None,
                        "uri": record.header["url"],
                        "date": warc_date(record.header["date"]),
                        "digest": sha1_base32(payload),
                        "payload_bytes": len(payload),
                        "arc": " ".join(record.header.values()).encode() + b"\n" + record.block,
                    }
                )
                size += len(record.block)
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD_FIELDS)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RECORD_FIELDS)


_RECORD_FIELDS = pa.schema(
    [
        ("record_id", pa.string()),
        ("number", pa.int64()),
        ("uri", pa.string()),
        ("date", pa.string()),
        ("digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("arc", pa.binary()),
    ]
)


def _files(data: bytes) -> Iterator[bytes]:
    """ARC files that follow each other in one, cut before each opening record."""
    at = start = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        stop = data.index(b"\n", at)
        if data.startswith(b"filedesc:", at) and at > start:
            yield data[start:at]
            start = at
        at = stop + 1 + int(data[at:stop].rpartition(b" ")[2])
    if start < len(data):
        yield data[start:]


def arc_records(files: DataFrame) -> DataFrame:
    """The records of ARC files (path, content), with their synthesised WARC identifiers, times and digests.

    ``number`` is the page number of an X-Page header, if there is one. A malformed file fails.
    """
    return files.select("path", "content").mapInArrow(_arc_records, _CONVERTED)


def _warc_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            line, _, block = row["arc"].partition(b"\n")
            values = line.decode().split(" ")
            version = 1 if len(values) == len(ARC_FIELDS[1]) else 2
            record = ArcRecord(version, 0, dict(zip(ARC_FIELDS[version], values)), block)
            first = None
            if row["first_id"] is not None and row["first_id"] != row["record_id"]:
                first = row["first_id"], row["first_uri"], row["first_date"]
            out.append(warc_record(record, row["record_id"], first))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def warc_records(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A WARC record for each of ``arc_records``, as rows of one binary column.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest number
    (null: smallest; then the largest id) is a response and the others revisit it; others are all responses.
    """
    best = F.max_by(F.struct("record_id", "uri", "date"), F.struct("number", "record_id")).alias("first")
    first = (
        records.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("digest")
        .agg(best, F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", *(F.col(f"first.{a}").alias(f"first_{b}") for a, b in (("record_id", "id"), ("uri", "uri"), ("date", "date"))))
    )
    joined = records.join(first, "digest", "left").select("record_id", "arc", "first_id", "first_uri", "first_date")
    return joined.mapInArrow(_warc_rows, "record binary")


_READ = (
    "record_id string, refers_to_id string, number long, uri string, date string, record_type string, "
    "payload_digest string, payload_bytes long"
)
_READ_FIELDS = pa.schema(
    [
        ("record_id", pa.string()),
        ("refers_to_id", pa.string()),
        ("number", pa.int64()),
        ("uri", pa.string()),
        ("date", pa.string()),
        ("record_type", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
    ]
)


def _urn(value: str | None) -> str | None:
    return value[len("<urn:uuid:") : -1] if value else None


def _read_warc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(1).to_pylist():
            rows = []
            for headers, block in parse_warc(_plain(content)):
                head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                page = re.search(rb"\r\nX-Page: (-?\d+)(?:\r\n|$)", head)
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                revisit = headers["warc-type"] == "revisit"
                if f"sha1:{sha1_base32(block)}" != headers["warc-block-digest"]:
                    raise ValueError("a block differs from its digest")
                if not revisit and sha1_base32(payload) != digest:
                    raise ValueError("a payload differs from its digest")
                rows.append(
                    {
                        "record_id": _urn(headers["warc-record-id"]),
                        "refers_to_id": _urn(headers.get("warc-refers-to")),
                        "number": int(page[1]) if page else None,
                        "uri": headers["warc-target-uri"],
                        "date": headers["warc-date"],
                        "record_type": headers["warc-type"],
                        "payload_digest": digest,
                        "payload_bytes": int(headers["x-payload-length"]) if revisit else len(payload),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, _READ_FIELDS)


def read_warc(files: DataFrame) -> DataFrame:
    """The records of WARC files (path, content). Digests are checked against what was read."""
    return files.select("path", "content").mapInArrow(_read_warc, _READ)


def archived(pages: DataFrame, folder: str, version: int = 1, least_bytes: int = 0) -> DataFrame:
    """Pages through ARC files and WARC files in ``folder`` (shared by all tasks) and back.

    ``pages`` has number, url, date and payload (a string in UTF-8); the result has the number,
    payload_bytes, payload_digest, record_type and refers_to, the number of the response that a
    revisit refers to. A null payload is an empty one, a null url or date is written as "-" and
    white space in them as "%20". Pages that repeat a number are records of their own; a null
    number comes back null. Other columns don't matter; an empty table has no records.
    """
    spark = pages.sparkSession
    write_archive(arc_files(pages, version), f"{folder}/arc", "\n", FILE_CHUNKS)
    write_archive(warc_records(arc_records(read_archive(spark, f"{folder}/arc")), least_bytes), f"{folder}/warc")
    records = read_warc(read_archive(spark, f"{folder}/warc"))
    response = records.select(F.col("record_id").alias("refers_to_id"), F.col("number").alias("refers_to"))
    return records.join(response, "refers_to_id", "left").select(
        "number", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
