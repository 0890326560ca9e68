"""WARC archives: written record by record, read back by byte ranges.

Writing goes through Spark's own text writer, so its commit protocol holds and any file system it
knows will do. Every record is one gzip member; as a member of less than 16 MiB ends in a zero byte
(the top of its length), that byte serves as the writer's line separator and the file is a plain
run of members. A longer record gets an empty member behind it, which ends in a zero byte too.

Reading is splittable: a task gets a byte range, scans it for the gzip magic, and takes a place for
a record if it decodes to a WARC header and the member ends with a right checksum, followed by
another member or the end of the file. A task owns the records that start inside its range and
reads past its end to finish the last. Memory is bounded by the range's read-ahead and one batch of
records, or the longest record.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_BATCH = 8 << 20
_STORED = 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

RECORD = (
    "file string, offset long, record_id string, record_type string, target_uri string, "
    "refers_to string, payload_digest string, payload_length long, payload binary"
)


def record_bytes(
    record_id: str, uri: str | None, payload: bytes, sha1: str, length: int, refers_to: str | None
) -> bytes:
    """One record: a response with its payload, or a revisit without it that refers to another."""
    body = b"" if refers_to else payload
    block = _HTTP % length + body
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
    ]
    if uri:
        lines.append(f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to:
        lines.append(f"WARC-Refers-To: <{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that ends in a zero byte, by an empty one behind it if need be."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    packed = packer.compress(data) + packer.flush()
    if packed[-1]:
        packed += zlib.compressobj(level, zlib.DEFLATED, 31).flush()
    return packed


def with_revisits(pages: DataFrame, page_id: str, payload: str, least_bytes: int) -> DataFrame:
    """Add `__data`, `__bytes`, `__sha1` and `__refers`, the id of the page that holds the payload.

    Of equal payloads of at least `least_bytes` that with the largest id holds it; rows that share
    that id hold it each. A null payload is an empty one. Without any id in a group, all hold it.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    keyed = pages.withColumn("__data", data).withColumns(
        {"__bytes": F.octet_length("__data").cast("long"), "__sha1": F.sha1("__data"), "__key": F.sha2("__data", 256)}
    )
    owners = (
        keyed.where(F.col("__bytes") >= least_bytes)
        .groupBy("__key")
        .agg(F.max(page_id).alias("__owner"), F.count(F.lit(1)).alias("__copies"))
        .where("__copies > 1")
        .drop("__copies")
    )
    refers = F.when(~F.col(page_id).eqNullSafe(F.col("__owner")), F.col("__owner"))
    return keyed.join(owners, "__key", "left").withColumn("__refers", refers)


def write_archive(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 1000,
) -> None:
    """Write a record per row under `path`, a new folder; an empty table gives files without any."""

    @F.arrow_udf("binary")
    def pack(ids: pa.Array, urls: pa.Array, data: pa.Array, sizes: pa.Array, sha1: pa.Array, refers: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (ids, urls, data, sizes, sha1, refers)), strict=True)
        packed = []
        for number, uri, body, size, digest, other in rows:
            name, target = f"urn:page:{number}", None if other is None else f"urn:page:{other}"
            packed.append(member(record_bytes(name, uri, body, digest, size, target))[:-1])
        return pa.array(packed, pa.binary())

    rows = with_revisits(pages, page_id, payload, least_bytes)
    # A revisit's payload stays out of the record, and so out of the way to Python.
    data = F.when(F.col("__refers").isNull(), F.col("__data")).otherwise(F.lit(b""))
    packed = pack(F.col(page_id), F.col(url), data, F.col("__bytes"), F.col("__sha1"), F.col("__refers"))
    # The cast keeps the bytes as they are, and the writer writes them as they are.
    rows.select(packed.cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


class _Source:
    """Positioned reads of a file by URI, with a window of read-ahead."""

    def __init__(self, uri: str, length: int):
        from pyarrow import fs

        if re.match(r"file:/(?!//)", uri):
            uri = "file://" + uri[5:]
        system, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
        self.file, self.length = system.open_input_file(path), length
        self.at, self.held = 0, b""

    def read(self, at: int, size: int = _READ) -> bytes:
        """Up to `size` bytes from `at`, at least a magic's if there are so many; none at the end."""
        wanted = min(at + min(size, len(MAGIC)), self.length)
        if not self.at <= at < wanted <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(_READ, max(0, self.length - at)))
        return self.held[at - self.at : at - self.at + size]

    def close(self) -> None:
        self.file.close()


def _unpacked(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The record in the member at `at` and where the member ends; None if it is not one.

    The first bytes are judged first, so a false magic costs one read. The header may be of any length:
    a url is. Empty data is an empty member.
    """
    unpacker, data, place, checked = zlib.decompressobj(31), bytearray(), at, False
    while not unpacker.eof:
        chunk = source.read(place)
        if not chunk:
            return None
        try:
            data += unpacker.decompress(chunk)
        except zlib.error:
            return None
        place += len(chunk)
        if not checked and (len(data) >= 5 or unpacker.eof):
            if data and not data.startswith(b"WARC/"):
                return None
            checked = True
    return bytes(data), place - len(unpacker.unused_data)


def _parsed(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields, by lower-case name, and the block; None if it is cut short."""
    head, found, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not found or not size.isdigit() or len(rest) < int(size):
        return None
    return fields, rest[: int(size)]


def records_in_range(source: _Source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records that start in [start, end).

    What is found by scanning may lie in the payload of another record, if that holds an archive of
    its own which was stored rather than compressed. But a stored block has less than 64 KiB: a run
    of members that goes on for longer, or up to the end of the file, is the file's own. Until then
    records are held back, past the end of the range if need be; of a run that breaks off they are
    dropped.
    """
    place, began, held, sure = start, start, [], start == 0
    following = sure  # whether `place` follows a member, or is the start of the file
    while place < end or held:
        if following:
            found = 0 if source.read(place, len(MAGIC)) == MAGIC else -1
        else:
            chunk = source.read(place, min(_READ, end - place + len(MAGIC) - 1))
            found = chunk.find(MAGIC)
        unpacked = _unpacked(source, place + found) if found >= 0 and place + found < source.length else None
        if unpacked is None:
            if following:  # the run broke off
                held, following, sure = [], False, False
                continue
            place += found + 1 if found >= 0 else max(1, len(chunk) - len(MAGIC) + 1)
            continue
        place += found
        if not following:
            began, following = place, True
        data, after = unpacked
        record = _parsed(data) if data and place < end else None
        if record:
            held.append((place, *record))
        place = after
        sure = sure or place - began >= _STORED or place >= source.length
        if sure:
            yield from held
            held = []


def _hex_digest(field: str | None) -> str | None:
    kind, _, value = (field or "").partition(":")
    try:
        return base64.b32decode(value).hex() if kind == "sha1" else None
    except ValueError:
        return None


def read_archive(spark: SparkSession, path: str, range_bytes: int = 8 << 20) -> DataFrame:
    """The records of all files under `path`, with the payload of each (a revisit's is empty)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
        .where("length > 0")
    )
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", starts.alias("start"))
    tasks = max(1, ranges.count())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _scanned(row["path"], row["length"], row["start"], range_bytes)

    return ranges.repartition(tasks).mapInArrow(scan, RECORD)


_KIND = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_length", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _scanned(path: str, length: int, start: int, range_bytes: int) -> Iterator[pa.RecordBatch]:
    source, rows, held = _Source(path, length), [], 0
    try:
        for offset, fields, block in records_in_range(source, start, min(length, start + range_bytes)):
            payload = block.partition(b"\r\n\r\n")[2] if "http" in fields.get("content-type", "") else block
            size = fields.get("x-payload-length", "")
            rows.append(
                {
                    "file": path,
                    "offset": offset,
                    "record_id": fields.get("warc-record-id", "").strip("<>") or None,
                    "record_type": fields.get("warc-type"),
                    "target_uri": fields.get("warc-target-uri"),
                    "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
                    "payload_digest": _hex_digest(fields.get("warc-payload-digest")),
                    "payload_length": int(size) if size.isdigit() else None,
                    "payload": payload,
                }
            )
            held += len(payload)
            if held >= _BATCH:
                yield pa.RecordBatch.from_pylist(rows, _KIND)
                rows, held = [], 0
    finally:
        source.close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _KIND)


def page_number(urn: Column) -> Column:
    """The id in a record's name; null for a page without one."""
    return F.regexp_extract(urn, r"^urn:page:(-?[0-9]+)$", 1).try_cast("long")
