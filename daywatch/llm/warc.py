"""WARC archives: a writer with revisit records and a sequential reader.

Every record is a gzip member of its own. The reader goes through an archive in chunks: it
inflates one member after the other, cuts the record by its content length and checks its
digests, and never holds more than one record. Archives are files of the shared store,
opened through Arrow's file systems (local and mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daywatch.llm.text import small_batches, stored

#: Payloads below this size are never stored as revisits.
LEAST_REVISIT = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
#: Records that are handed to Spark at once.
BATCH_RECORDS = 200
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORD = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, "
    "payload_digest string, digest_ok boolean, payload binary"
)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (pafs.LocalFileSystem(), path)


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of each page; refers_to as in ``write``."""
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.octet_length("payload") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return rows.join(firsts, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))
        .otherwise(F.when(F.col("page_id").isNull(), F.col("first_id")))
        .alias("refers_to"),
    )


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        # A line end in a URL would end the header.
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<{record_id(refers_to)}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + member.flush()


def record_id(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per page into archives below ``folder``; returns their manifest.

    Of pages with equal payloads of 100 bytes or more, the one with the smallest id is a
    response and the others revisit it; smaller payloads are all responses. A null payload is
    empty, a null URL leaves its header out. A null id ranks last; without any other id in
    its group such a page is a response. Rows that repeat the smallest id are responses each, under
    one record id, as are rows that repeat an id otherwise: a record a row. An empty table
    gives an empty manifest. Payloads of any length are one record; other columns don't matter.

    Every attempt of a task writes files of its own, and the manifest (``path, records,
    bytes``, a stored table) has those of the attempts that counted: what lost or repeated
    attempts leave behind is never read.
    """
    planned = plan_records(pages, id_col, url_col, payload_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, done, records, size = None, [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_RECORDS):
                for row in zip(*[c.to_pylist() for c in batch.slice(at, BATCH_RECORDS).columns]):
                    if out is None:
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(f"{root}/{name}")
                    member = record_bytes(*row, date)
                    out.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= archive_bytes:
                        out.close()
                        done.append((f"{folder}/{name}", records, size))
                        out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        columns = list(zip(*done)) if done else [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "records", "bytes"])

    return stored(small_batches(planned).mapInArrow(run, MANIFEST), "manifest")


class Damaged(ValueError):
    """An archive that does not keep to the format."""


def members(stream, name: str) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of inflated chunks to be used up in turn."""
    left = stream.read(READ_BYTES)
    while left:
        inflate = zlib.decompressobj(31)

        def chunks() -> Iterator[bytes]:
            nonlocal left
            while not inflate.eof:
                if not left:
                    left = stream.read(READ_BYTES)
                    if not left:
                        raise Damaged(f"{name} ends within a record")
                out = inflate.decompress(left, READ_BYTES)
                left = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if out:
                    yield out

        yield chunks()
        left = left or stream.read(READ_BYTES)


def records(stream, name: str, keep_payload: bool) -> Iterator[tuple]:
    """Rows of ``RECORD`` of one archive, in order."""
    for member in members(stream, name):
        head, rest = _until(member, b"", b"\r\n\r\n", name)
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise Damaged(f"{name} has a member that is no record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        kind, block_sum, payload_sum = fields["warc-type"], hashlib.sha256(), hashlib.sha256()
        stated, body_size, kept = None, 0, []
        is_http = fields.get("content-type", "").startswith("application/http")
        http = b"" if is_http else None
        seen = 0
        for chunk in _with(rest, member):
            part = chunk[: length - seen]
            seen += len(part)
            block_sum.update(part)
            if http is not None:
                http += part
                end = http.find(b"\r\n\r\n")
                if end < 0:
                    continue
                for line in http[:end].split(b"\r\n")[1:]:
                    key, _, value = line.partition(b":")
                    if key.strip().lower() == b"content-length":
                        stated = int(value)
                part, http = http[end + 4 :], None
            body_size += len(part)
            payload_sum.update(part)
            if keep_payload:
                kept.append(part)
        if seen < length:
            raise Damaged(f"{name} has a record shorter than its content length")
        told = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        ok = _agrees(fields.get("warc-block-digest"), block_sum.hexdigest())
        if kind == "revisit":
            size, digest = stated, told or None
        else:
            size, digest = body_size, payload_sum.hexdigest()
            ok = ok and _agrees(fields.get("warc-payload-digest"), digest)
        bare = lambda k: fields[k].strip("<>") if k in fields else None
        payload = b"".join(kept) if keep_payload and kind != "revisit" else None
        yield (
            bare("warc-record-id"), kind, fields.get("warc-target-uri"), bare("warc-refers-to"), size, digest, ok, payload,
        )


def _until(member: Iterator[bytes], held: bytes, end: bytes, name: str) -> tuple[bytes, bytes]:
    for chunk in member:
        held += chunk
        at = held.find(end)
        if at >= 0:
            return held[:at], held[at + len(end) :]
    raise Damaged(f"{name} has a record without an end of its header")


def _with(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _agrees(stated: str | None, digest: str) -> bool:
    """Whether a stated digest holds; those of other algorithms are not checked."""
    return stated is None or not stated.startswith("sha256:") or stated == f"sha256:{digest}"


def read(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of archives (column ``path``), as rows of ``RECORD``.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload: of a response as
    read, of a revisit as its headers state. ``digest_ok`` is false where a stated SHA-256
    digest of block or payload does not hold. A damaged archive fails the query. An archive is
    one task, as gzip members have to be read in turn.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = StructType.fromDDL(RECORD)
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = file_system(path)
                with system.open_input_stream(at) as stream:
                    rows = []
                    for row in records(stream, path, keep_payload):
                        rows.append(row)
                        if len(rows) == BATCH_RECORDS:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    # A task an archive; a number that is given isn't reduced for how little the paths weigh.
    paths = archives.select("path")
    return small_batches(paths.repartition(max(1, paths.count()))).mapInArrow(run, schema)
