import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from daywatch.llm import warc
from daywatch.session import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, refers_to int"
BIG = "<p>é</p>" * 40
ROWS = [
    (7, "http://a/", BIG), (3, "http://b/", BIG), (5, None, BIG), (1, "http://c/", "small"), (2, "http://d/", "small"), (4, "http://e/", None),
    (6, "http://f/\r\nX: y", ""), (8, "http://g/", "x" * 3_000_000), (9, "http://g/2", "x" * 3_000_000), (None, "http://h/", BIG), (None, "http://i/", "z" * 200),
    (10, "http://j/", "WARC/1.1\r\n\r\n" * 30),
]


@pytest.fixture(scope="module")
def written(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA)
    return warc.write(pages, scratch_path(spark, "warc"), archive_bytes=2000)


def expected():
    first = {}
    for i, _, html in ROWS:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        ref = first.get(data)
        ref = None if ref == i else ref
        out.append((f"urn:page:{'' if i is None else i}", "response" if ref is None else "revisit", len(data), hashlib.sha256(data).hexdigest(), ref and f"urn:page:{ref}", True))
    return sorted(out, key=repr)


def test_round_trip(written):
    got = warc.read(written)
    columns = ["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "digest_ok"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == expected()
    payloads = {r["record_id"]: r["payload"] for r in got.where("record_type = 'response'").collect()}
    assert bytes(payloads["urn:page:8"]) == b"x" * 3_000_000 and bytes(payloads["urn:page:3"]) == BIG.encode()
    assert got.where("record_id = 'urn:page:6'").first()["target_uri"] == "http://f/%0D%0AX: y"
    assert written.agg(F.sum("records")).first()[0] == len(ROWS) and written.count() > 1


def test_each_record_is_a_member(written):
    path = written.first()["path"]
    system, at = warc.file_system(path)
    data = system.open_input_stream(at).read()
    assert gzip.decompress(data).count(b"WARC-Record-ID: ") == written.first()["records"]
    assert data.count(b"\x1f\x8b\x08") >= written.first()["records"]


def record(payload=b"y" * 500, **changed):
    data = gzip.decompress(warc.record_bytes(1, "http://a/", payload, hashlib.sha256(payload).hexdigest(), None, "2020-01-01T00:00:00Z"))
    for old, new in changed.values():
        assert old in data
        data = data.replace(old, new)
    return gzip.compress(data)


def read(data, size=None):
    if size:
        warc.READ_BYTES, kept = size, warc.READ_BYTES
    try:
        return list(warc.records(io.BytesIO(data), "here", True))
    finally:
        if size:
            warc.READ_BYTES = kept


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_any_chunk_size(size):
    rows = read(record() + record(b"") + record(b"\r\n\r\n" * 50), size)
    assert [r[4] for r in rows] == [500, 0, 200] and all(r[6] for r in rows)
    assert rows[2][7] == b"\r\n\r\n" * 50


def test_damage_is_seen():
    assert [r[6] for r in read(record(a=(b"yyyyyyyyyy", b"yyyyxyyyyy")))] == [False]
    with pytest.raises(warc.Damaged):
        read(record()[:-20])
    with pytest.raises(warc.Damaged):
        read(record(a=(b"WARC/1.1", b"HTTP/1.1")))
    with pytest.raises(warc.Damaged):
        read(record(a=(b"y" * 500, b"")))


def test_empty(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert warc.read(warc.write(pages, scratch_path(spark, "warc"))).count() == 0
