import gzip
import hashlib

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string"


def rows():
    long, other = "é" * 700, "y" * 5000
    return [(1, "http://a/1", "short"), (2, "http://a/2", "short"), (3, "u\r\nv", long), (5, None, long), (4, "http://a/4", long), (6, "http://b", None), (7, "http://c", ""), (8, "http://d", other), (8, "http://d", other), (None, "http://e", other), (9, "http://f", "a\r\n\r\nWARC/1.1\r\n" * 100)]


def test_round_trip(spark):
    pages = spark.createDataFrame(rows(), SCHEMA)
    archives = warc.write_archives(pages)
    chunks = warc.read_chunks(archives, chunk=512).collect()
    last = [c for c in chunks if c.last]
    assert len(last) == len(rows())
    want = []
    for i, _, html in rows():
        data = (html or "").encode()
        same = [r[0] for r in rows() if (r[2] or "").encode() == data and r[0] is not None]
        refers = max(same) if len(data) >= 1000 and i != max(same) else None
        want.append((warc.record_id(i), "revisit" if refers else "response", warc.record_id(refers) if refers else None, len(data), hashlib.sha1(data).hexdigest()))
    assert sorted((c.record_id, c.record_type, c.refers_to, c.payload_bytes, c.digest) for c in last) == sorted(want) or sorted(map(repr, want)) == sorted(repr((c.record_id, c.record_type, c.refers_to, c.payload_bytes, c.digest)) for c in last)
    for c in last:
        if c.record_type == "response":
            own = sorted((x for x in chunks if x.record_id == c.record_id and x.record_type == "response"), key=lambda x: x.chunk_no)
            parts = {x.chunk_no: bytes(x.data) for x in own}
            data = b"".join(parts[k] for k in sorted(parts))
            assert hashlib.sha1(data).hexdigest() == c.digest and all(x.size <= 512 for x in own)
            at = 0
            for k in sorted(parts):
                at += len(parts[k])
                assert {x.digest for x in own if x.chunk_no == k} == {hashlib.sha1(data[:at]).hexdigest()}


def test_files_are_warc(spark):
    archives = warc.write_archives(spark.createDataFrame([(1, "http://a", "hello")], SCHEMA)).collect()
    data = gzip.open(archives[0].path.removeprefix("file:")).read() if archives[0].path.startswith("file:") else gzip.open(archives[0].path).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\nhello\r\n\r\n")


def test_damage_is_noticed(spark):
    archives = warc.write_archives(spark.createDataFrame([(1, "http://a", "hello")], SCHEMA))
    path = archives.collect()[0].path.removeprefix("file:")
    data = gzip.open(path).read().replace(b"hello", b"hullo")
    with gzip.open(path, "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="damaged"):
        warc.read_chunks(archives).collect()


def test_only_named_archives_are_read(spark):
    pages = spark.createDataFrame([(1, "http://a", "one")], SCHEMA)
    archives = warc.write_archives(pages)
    folder = archives.collect()[0].path.rsplit("/", 1)[0]
    w = warc.Writer(folder)
    w.write(2, None, memoryview(b"left behind"), hashlib.sha1(b"left behind").hexdigest(), None)
    w.close()
    assert [c.record_id for c in warc.read_chunks(archives).collect()] == [warc.record_id(1)]


def test_empty(spark):
    archives = warc.write_archives(spark.createDataFrame([], SCHEMA))
    assert archives.count() == 0 and warc.read_chunks(archives).count() == 0
