"""WARC archives written and read as streams, and the chunked record table in between.

Each task writes archives of its own, a gzip member for each record, under a name that no other attempt uses, into the
shared folder; its rows name the archives it closed. Only archives so named are read, so what a lost or repeated attempt
leaves behind doesn't count. Reading gives a row for each chunk of a payload, with the digest so far; no record is held
whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, few_rows, fresh_path, lean, ship

CHUNK = 1 << 20
#: Payloads of fewer bytes are never left out.
MIN_REVISIT = 1000
#: Bytes of payload after which a task starts its next archive.
ROTATE = 1 << 27
DATE = "1970-01-01T00:00:00Z"
#: Digests of which a list may be broadcast.
FEW = 200_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "urn:tidemark:page:"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{posixpath.abspath(path)}")


def record_id(page_id: int | None) -> str:
    return f"<{_RECORD}{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    tail = (record or "").strip("<>").removeprefix(_RECORD)
    return int(tail) if tail else None


def _header(page_id: int | None, url: str | None, n: int, digest: str, refers: int | None) -> bytes:
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    uri = "".join(c if " " < c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha}"]
    if refers is None:
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {n}"]
    else:
        lines += [f"WARC-Refers-To: {record_id(refers)}", f"WARC-Profile: {_PROFILE}", f"WARC-Payload-Length: {n}", "Content-Length: 0"]
    return "\r\n".join([*lines, "", ""]).encode()


class Writer:
    """Archives of one task."""

    def __init__(self, folder: str, level: int = 3):
        self.fs, self.folder = _filesystem(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.level, self.out, self.closed = level, None, []

    def write(self, page_id: int | None, url: str | None, payload: memoryview, digest: str, refers: int | None) -> None:
        if self.out is None:
            self.name = f"part-{uuid.uuid4().hex}.warc.gz"
            self.out, self.records, self.size = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0, 0
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.out.write(z.compress(_header(page_id, url, len(payload), digest, refers)))
        if refers is None:
            for at in range(0, len(payload), CHUNK):
                self.out.write(z.compress(payload[at : at + CHUNK]))
            self.size += len(payload)
        self.out.write(z.compress(b"\r\n\r\n") + z.flush())
        self.records += 1
        if self.size >= ROTATE:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.closed.append((self.name, self.records))
            self.out = None


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(path, records): the archives that hold a record for each row of pages (page_id, url, html).

    The payload is html in UTF-8, empty for null. Of records with equal payloads of MIN_REVISIT bytes or more, those with
    the largest page_id are responses and the others revisit it; where all page_ids are null, and for shorter payloads,
    all are responses. Equal means equal length and SHA-1. Each row has its record, so repeated page_ids have several of the
    same name; other columns of pages don't count. An empty table gives no archives.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.select("page_id", "digest", F.length("payload").alias("n")).filter(F.col("n") >= MIN_REVISIT)
    kept = long.groupBy("digest", "n").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).filter("copies > 1").select(F.col("digest").alias("d"), "n", "kept")
    # up to FEW digests with several pages go to every task, so payloads stay where they are
    met = rows.join(few_rows(kept, FEW), (F.col("digest") == F.col("d")) & (F.length("payload") == F.col("n")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Writer(folder)
        for b in batches:
            ids, urls, digests, to = (b.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers"))
            for i, payload in enumerate(b.column("payload")):
                w.write(ids[i], urls[i], memoryview(payload.as_buffer()), digests[i], to[i])
        w.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in w.closed], pa.string()), pa.array([r for _, r in w.closed], pa.int64())], names=["path", "records"])

    return cut(met.select("page_id", "url", "payload", "digest", refers.alias("refers")).mapInArrow(lean(run), "path string, records long"))


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], int]]:
    """(header fields, content length) of each record; the caller reads the content before it goes on."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, int(fields["content-length"])


def read_chunks(archives: DataFrame, data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives in column path: a row for each chunk of a payload, one if it is empty.

    (record_id, record_type, refers_to, chunk_no, start, size, data, digest, last, payload_bytes): digest is the SHA-1 of
    the payload up to the chunk's end, last marks the payload's end; there it must be the record's own, or reading fails.
    A revisit has one row without data, and the digest and length of the payload that it refers to. Without data, data
    is null. A chunk is at most chunk bytes, and so is what a task holds of a payload.
    """
    schema = "record_id string, record_type string, refers_to string, chunk_no long, start long, size long, data binary, digest string, last boolean, payload_bytes long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.int64()]

    def rows_of(path: str) -> Iterator[tuple]:
        fs, name = _filesystem(path)
        with fs.open_input_stream(name, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as stream:
            for fields, left in _records(stream):
                rid, kind, to = fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to")
                want = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "revisit":
                    yield rid, kind, to, 0, 0, 0, None, want, True, int(fields["warc-payload-length"])
                    continue
                sha, n, at, k = hashlib.sha1(), left, 0, 0
                while left or not k:
                    got = stream.read(min(chunk, left))
                    if left and not got:
                        raise EOFError(f"{path} ends within {rid}")
                    left -= len(got)
                    sha.update(got)
                    digest = sha.hexdigest()
                    if not left and digest != want:
                        raise ValueError(f"{rid} in {path} is damaged")
                    yield rid, kind, to, k, at, len(got), got if data else None, digest, not left, n
                    at, k = at + len(got), k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                for row in rows_of(path):
                    held.append(row)
                    size += 200 + (row[5] if data else 0)
                    if size >= 4 * CHUNK:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def _batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    ship(archives.sparkSession)
    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, schema)


def page_id_of(column: str):
    """The page_id within a record identifier."""
    return F.regexp_extract(column, r"(-?\d+)>$", 1).try_cast("long")
