r"""WARC archives as a chunked record table.

Every page becomes one WARC/1.0 record.  The archive is a table of (archive, record, chunk_no, chunks, data): the
record's bytes are its chunks in order, ``chunk_bytes`` at most each, so that neither the writer nor the reader joins
an oversized payload into one piece.  The reader follows the chunks with a small state machine (WARC header, HTTP
header, payload, trailer), carries length and SHA-1 along, and holds the outcome against Content-Length and
WARC-Payload-Digest.  Records of one chunk are read where they lie; those of more are dealt by record and sorted.

Of payloads that are equal and have ``least_bytes`` or more, the largest page_id is a response and the others are
revisits (profile identical-payload-digest, no payload, the HTTP header with the full Content-Length).

Defined results: null html is an empty payload; a null url leaves the target out; CR and LF in a url are
percent-encoded; a null page_id never is the response while an equal payload has an id, and refers to it; rows with
the same page_id and payload are all responses if it is the largest; an empty table gives an empty archive; extra
columns are not looked at.  A damaged record fails with its name.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

CHUNK = 64 << 10
SCHEMA = "archive int, record long, chunk_no int, chunks int, data binary"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _head(page: int | None, url: str | None, size: int, digest: str, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if refers is not None else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _pieces(head: bytes, payload: memoryview, chunk: int) -> Iterator[bytes]:
    """The record's bytes, chunk by chunk: head, payload and the two closing line ends."""
    tail = b"\r\n\r\n"
    total = len(head) + len(payload) + len(tail)
    for at in range(0, total, chunk):
        end = min(total, at + chunk)
        piece = [head[at:end]] if at < len(head) else []
        a, b = max(at, len(head)) - len(head), min(end, len(head) + len(payload)) - len(head)
        if b > a:
            piece.append(payload[a:b])
        a, b = max(at, len(head) + len(payload)) - len(head) - len(payload), end - len(head) - len(payload)
        if b > a:
            piece.append(tail[a:b])
        yield b"".join(piece)


def archive(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunk table of all pages.  Equal payloads meet by digest through partial maxima, never as a group."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("sha", F.sha1("payload"))
    light = C.cut(rows.select("page_id", "sha", F.length("payload").alias("n")), "digests")
    most = light.filter(F.col("n") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("refers"), F.count("*").alias("rows")).filter("rows > 1 and refers is not null")
    revisits = C.hot_join(light.withColumn("spread", F.coalesce("page_id", F.lit(-1))), most, "sha", "spread").filter("not (page_id <=> refers)")
    revisits = C.cut(revisits.select(F.col("page_id").alias("r_page"), F.col("sha").alias("r_sha"), "refers").distinct(), "revisits")
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("sha") == F.col("r_sha")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, record = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for page, url, payload, sha, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha", "refers"))):
                body = memoryview(payload.as_buffer())
                page, refers = page.as_py(), refers.as_py()
                head = _head(page, url.as_py(), len(body), _base32(bytes.fromhex(sha.as_py())), refers)
                body = body if refers is None else body[:0]
                chunks = -(-(len(head) + len(body) + 4) // chunk_bytes)
                for k, data in enumerate(_pieces(head, body, chunk_bytes)):
                    out.append((name, record, k, chunks, data))
                    held += len(data)
                    if held > 4 << 20:
                        yield _rows(out)
                        out, held = [], 0
                record += 1
            if out:
                yield _rows(out)

    return rows.select("page_id", "url", "payload", "sha", "refers").mapInArrow(write, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.record_batch({"archive": pa.array(columns[0], pa.int32()), "record": pa.array(columns[1], pa.int64()), "chunk_no": pa.array(columns[2], pa.int32()), "chunks": pa.array(columns[3], pa.int32()), "data": pa.array(columns[4], pa.binary())})


class Record:
    """Reads one record from its chunks; only headers are held, payload bytes go into the digest and are let go."""

    def __init__(self, name: str) -> None:
        self.name, self.head, self.fields, self.http = name, b"", None, None
        self.sha, self.size, self.left = hashlib.sha1(), 0, 0
        self.tail = b""

    @staticmethod
    def _parse(raw: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "surrogateescape").split("\r\n")[1:])}

    def feed(self, data: bytes) -> None:
        if self.http is None:
            self.head += data
            data = b""
            if self.fields is None and (at := self.head.find(b"\r\n\r\n")) >= 0:
                if not self.head.startswith(b"WARC/"):
                    raise ValueError(f"{self.name}: no WARC record")
                self.fields, self.head = self._parse(self.head[:at]), self.head[at + 4:]
                self.left = int(self.fields["content-length"])
            if self.fields is not None and (at := self.head.find(b"\r\n\r\n")) >= 0:
                self.http, data, self.head = self._parse(self.head[:at]), self.head[at + 4:], b""
                self.left -= at + 4
        if self.http is not None:
            n = min(len(data), self.left)
            self.sha.update(memoryview(data)[:n])
            self.size, self.left = self.size + n, self.left - n
            self.tail += data[n:]

    def result(self) -> tuple:
        if self.http is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError(f"{self.name}: record cut short")
        digest, kind = self.fields["warc-payload-digest"].removeprefix("sha1:"), self.fields["warc-type"]
        if kind == "response" and (_base32(self.sha.digest()) != digest or self.size != int(self.http["content-length"])):
            raise ValueError(f"{self.name}: payload does not match its digest")
        number = lambda x: int(y) if (y := x[len("<urn:x-page:"):-1]) else None
        return number(self.fields["warc-record-id"]), int(self.http["content-length"]), digest, kind, number(self.fields["warc-refers-to"]) if kind == "revisit" else None


def read(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of a chunk table."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Record | None = None
        out: list[tuple] = []
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name, record, k, n, data in zip(*(batch.column(c).to_pylist() for c in ("archive", "record", "chunk_no", "chunks", "data"))):
                if k == 0:
                    now = Record(f"archive {name}, record {record}")
                now.feed(data)
                if k == n - 1:
                    out.append(now.result())
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []

    long = chunks.filter("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk_no")
    return chunks.filter("chunks = 1").mapInArrow(parse, READ).union(long.mapInArrow(parse, READ))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(C.cut(archive(C.table(spark, sf_dir, "pages")), "archives"))


QUERIES = {"op3_warc": op3_warc}
_FIVE = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v{k} >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))  # 20 bits at a time
_BLOCKS = ", ".join(f"CAST('0x' || substr(h, {5 * k + 1}, 5) AS INTEGER) AS v{k}" for k in range(8))
ORACLE = {"op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS most FROM p),
v AS (SELECT *, {_BLOCKS} FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_FIVE} AS payload_digest, CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> most THEN most END AS refers_to FROM v"""}
