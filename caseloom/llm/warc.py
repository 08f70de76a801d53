"""WARC archives: one gzip member per record, written by tasks and read back by byte ranges.

A reading task scans its range for the gzip magic, keeps those places whose decoded bytes begin with a WARC header, and
owns the records that start inside its range, wherever they end.  The bytes 1F 8B are not part of valid UTF-8, so a text
payload that gzip stores as it is cannot look like a member.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.session import checkpoint_folder, cut_lineage

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read at once, and the longest header looked for.
READ, HEADER = 1 << 18, 1 << 16


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that executors share: file:, hdfs:, s3: or a plain absolute path."""
    return fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int) -> bytes:
    """One record as a gzip member.  A revisit has HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(fields).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at least `min_bytes` the largest page_id is kept.

    Equality is by SHA-1.  Only digests that occur more than once are joined back, as one row each; where they are many,
    Spark shuffles and AQE splits a frequent digest.  Rows that repeat the largest page_id are all responses.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    )
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_warc(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 4, file_bytes: int = 1 << 30) -> DataFrame:
    """Write the rows of mark_revisits below `folder`; returns the manifest (path, bytes, records), itself a written table.

    Each attempt of a task writes files of its own name and the manifest lists those of the attempt that counted, so
    files of lost executors are never read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        files.create_dir(path)
        out, name, written, count, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, written, count = f"{TaskContext.get().partitionId():06d}-{uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url, payload, base64.b32encode(digest).decode(), refers_to, date, level)
                out.write(member)
                written, count = written + len(member), count + 1
                if written >= file_bytes:
                    out.close()
                    out = done.append((f"{folder}/{name}", written, count))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", written, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "bytes", "records"])

    return cut_lineage(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, bytes bigint, records bigint"))


class _Window:
    """Bytes of a file around a moving place."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start, self.data = file, start, b""
        self.file.seek(start)

    def more(self) -> bool:
        got = self.file.read(READ)
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        """Forget what lies before the place `to` of the file."""
        self.data, self.start = self.data[to - self.start:], to


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member that begins at `at`, and where it ends; None if no WARC record begins there."""
    decode, parts, used, known = zlib.decompressobj(31), [], at - window.start, False
    try:
        while not decode.eof:
            if used >= len(window.data) and not window.more():
                return None
            part = window.data[used:used + READ]
            used += len(part)
            parts.append(decode.decompress(part))
            if not known:
                head = b"".join(parts)[:5]
                if not b"WARC/".startswith(head):
                    return None
                known = len(head) == 5
    except zlib.error:
        return None
    return (b"".join(parts), window.start + used - len(decode.unused_data)) if known else None


def parse_record(data: bytes) -> dict | None:
    """Fields of a record: lower-case header names, and `block`; None without a whole header and block."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    found = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}
    size = found.get("content-length", "")
    if not gap or not lines[0].startswith("WARC/") or not size.isdigit() or len(rest) < int(size):
        return None
    return found | {"block": rest[:int(size)]}


def scan_range(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records that begin in [start, end)."""
    window, at = _Window(file, start), start
    while at < end:
        place = window.data.find(MAGIC, at - window.start)
        if place < 0:
            at = max(at, window.start + len(window.data) - 2)
            window.drop(at)
            if not window.more():
                return
            continue
        at = window.start + place
        if at >= end:
            return
        window.drop(at)
        member = _member(window, at)
        fields = parse_record(member[0]) if member else None
        if fields is None:
            at += 1
            continue
        yield at, fields
        at = member[1]


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_warc(manifest: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """(page_id, url, record_type, payload, payload_digest, refers_to, path, offset) of all records of the files listed.

    Files are cut into ranges of `range_bytes`, dealt to tasks.  The digest of a response is computed from what was
    read; a revisit has a null payload and the digest of its header.
    """
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    count = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                files, inner = open_folder(path)
                with files.open_input_file(inner) as file:
                    rows, held = [], 0
                    for offset, fields in scan_range(file, start, min(size, start + range_bytes)):
                        rows.append(read_row(path, offset, fields))
                        held += len(rows[-1][3] or b"")
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    def read_row(path, offset, fields):
        kind, body = fields.get("warc-type"), fields["block"].partition(b"\r\n\r\n")[2]
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        url = fields.get("warc-target-uri")
        payload = None if kind == "revisit" else body
        return (
            _page(fields.get("warc-record-id")), None if url is None else _plain(url), kind, payload,
            digest if payload is None else base32_sha1(payload), _page(fields.get("warc-refers-to")), path, offset,
        )

    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["page_id", "url", "record_type", "payload", "payload_digest", "refers_to", "path", "offset"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "page_id bigint, url string, record_type string, payload binary, payload_digest string, refers_to bigint, path string, offset bigint"
    return ranges.repartition(int(count), "path", "start").mapInArrow(run, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_digest, refers_to, payload_bytes) with a revisit's length taken from its response."""
    seen = cut_lineage(records.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("bigint").alias("own")))
    responses = (
        seen.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own").alias("theirs"))
    )
    return seen.join(responses, ["refers_to", "payload_digest"], "left").select(
        "page_id", "record_type", "payload_digest", "refers_to", F.coalesce("own", "theirs").alias("payload_bytes"))


def archive_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives in the shared folder, read them back by ranges, resolve revisits.

    Null html is an empty payload, a null page_id stays null and is never referred to; repeated rows give a record
    each.  Other columns are not read.
    """
    folder = folder or f"{checkpoint_folder(pages.sparkSession)}/warc-{uuid4().hex}"
    return resolve_revisits(read_warc(write_warc(mark_revisits(pages, min_bytes), folder)))


def spark_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of archives that someone else wrote below `folder`."""
    files, path = open_folder(folder)
    found = [(f"{folder}/{f.path.removeprefix(path).lstrip('/')}", f.size) for f in files.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".warc.gz") and f.size]
    return spark.createDataFrame(found, "path string, bytes bigint")
