"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Each record is a gzip member of its own. Records with equal payloads of at least `least` bytes are
written once: that with the smallest page_id is the response, the others are revisits of it. A damaged
member or record ends where the next valid gzip member or version line begins; later records are read
on, and the bytes between are reported as gaps. The reader streams: it holds a window of the file and one
record at a time, whatever the size of the archive.

Defined results: null html is the empty payload; rows with the smallest page_id of their payload are all
responses if that page_id repeats; null page_ids sort after all others and refer to, but are never
referred to unless no page with that payload has an id; a null url gives no target header; an empty
table gives no file and no record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _spark

FILE_BYTES = 16 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A whole uncompressed record. A revisit holds the headers of its response, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {kind}')}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    pass


class Source:
    """Bytes of a seekable file by place; a window of it is held."""

    STEP = 1 << 18

    def __init__(self, f):
        self.f, self.at, self.held = f, 0, b""
        self.size = f.seek(0, 2) if not hasattr(f, "size") else f.size()

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.f.seek(at)
            self.at, self.held = at, self.f.read(max(n, self.STEP))
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: tuple[bytes, ...], at: int) -> int:
        """The next place of any of them; the end if there is none."""
        most = max(map(len, what)) - 1
        while at < self.size:
            some = self.read(at, self.STEP)
            found = [x for w in what if (x := some.find(w)) >= 0]
            if found:
                return at + min(found)
            if at + len(some) >= self.size:
                break
            at += len(some) - most
        return self.size


def _headers(data: bytes) -> dict[str, str]:
    head: dict[str, str] = {}
    for line in data.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise Damaged("no length")
    return head


#: Of a record's headers.
MOST_HEADERS = 1 << 20


def parse_record(read, at: int, left: int | None) -> tuple[dict[str, str], bytes, int] | None:
    """(headers in lower case, block, place after the record) of the record at `at`. read(at, n) gives bytes.

    left: bytes from there to the end; None if more may come: a record that is not whole yet is then None.
    """
    if (first := read(at, 7)) != b"WARC/1.":
        if left is None and b"WARC/1.".startswith(first):
            return None
        raise Damaged("no version line")
    n = 1 << 12
    while (end := read(at, n).find(b"\r\n\r\n")) < 0:
        if n >= MOST_HEADERS or (left is not None and n >= left):
            raise Damaged("headers do not end")
        if left is None and len(read(at, n)) < n:
            return None
        n *= 4
    head = _headers(read(at, end))
    a, size = at + end + 4, int(head["content-length"])
    if left is not None and end + 4 + size + 4 > left:
        raise Damaged("the block does not end where it should")
    block = read(a, size + 4)
    if len(block) < size + 4:
        return None
    if block[size:] != b"\r\n\r\n":
        raise Damaged("the block does not end where it should")
    return head, block[:size], a + size + 4


def check_record(head: dict[str, str], block: bytes) -> bytes:
    """The payload, if it has the stated digest (a revisit has none)."""
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    said = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and said.startswith("sha1:") and payload_digest(payload) != said[5:]:
        raise Damaged("the payload has another digest")
    return payload


GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."

Found = tuple[dict[str, str], bytes, int]


def _member(source: Source, at: int) -> Iterator[Found | tuple[int, str]]:
    """Records of the gzip member at `at` as they are inflated; last (place after it, why some of its text was not read, or nothing).

    A record is given at once if its payload's digest was checked, and others once the member's own check has passed.
    """
    z, text, i, why, place = zlib.decompressobj(31), b"", 0, "", at
    waiting: list[Found] = []

    def whole(last: bool) -> Iterator[Found]:
        nonlocal i, why
        while i < len(text):
            try:
                got = parse_record(lambda x, n: text[x : x + n], i, len(text) - i if last else None)
                if got is None:
                    return
                head, block, j = got
                payload = check_record(head, block)
                if head.get("warc-type") == "response" and "warc-payload-digest" in head:
                    yield head, payload, at
                else:
                    waiting.append((head, payload, at))
            except Damaged as e:
                why = str(e)
                j = text.find(VERSION, i + 1)
                j = (len(text) if last else max(i + 1, len(text) - len(VERSION))) if j < 0 else j
            i = j

    while not z.eof:
        some = source.read(place, 1 << 16)
        if not some:
            raise Damaged("a member does not end")
        try:
            text, i = text[i:] + z.decompress(some), 0
        except zlib.error as e:
            raise Damaged(str(e)) from None
        place += len(some)
        yield from whole(False)
    yield from whole(True)
    yield from waiting
    yield place - len(z.unused_data), why


def salvaged(source: Source) -> Iterator[tuple[str, tuple]]:
    """("record", (headers, payload, place)) of every record that passes its checks, ("gap", (first, past, why)) of every gap. Plain or gzip; one record is held at a time."""
    at, bad, bad_why = 0, -1, ""
    while at < source.size:
        try:
            to, why, found = at, "", []
            if source.read(at, 3) == GZIP:
                for x in _member(source, at):
                    if len(x) == 3:
                        if bad >= 0:
                            yield "gap", (bad, at, bad_why)
                            bad = -1
                        yield "record", x
                    else:
                        to, why = x
            elif source.read(at, 7) == VERSION:
                head, block, to = parse_record(source.read, at, source.size - at)
                found = [(head, check_record(head, block), at)]
            else:
                raise Damaged("neither a member nor a version line")
            if bad >= 0:
                yield "gap", (bad, at, bad_why)
                bad = -1
            if why:
                yield "gap", (at, to, why)
            for x in found:
                yield "record", x
            at = to
        except Damaged as e:
            if bad < 0:
                bad, bad_why = at, str(e)
            at = source.find((GZIP, VERSION), at + 1)
    if bad >= 0:
        yield "gap", (bad, source.size, bad_why)


def salvage(data: bytes) -> tuple[list[Found], list[tuple[int, int, str]]]:
    """All records and all gaps of an archive in memory."""
    got = list(salvaged(Source(io.BytesIO(data))))
    return [x for kind, x in got if kind == "record"], [x for kind, x in got if kind == "gap"]


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal k, size, n
            at = f"{folder}/pages-{part:06d}-{k:04d}.warc.gz"
            _spark.write_file(at, b"".join(held))
            out = pa.record_batch([pa.array([at]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "n_bytes"])
            k, size, n = k + 1, 0, 0
            held.clear()
            return out

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "first_id", "refers")]
            for row in zip(*cols, strict=True):
                page_id, url, html, first, refers = (x.as_py() for x in row)
                data = member(record("revisit" if refers else "response", page_id, url, html.encode() if html else b"", first if refers else None))
                held.append(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    yield close()
        if held:
            yield close()

    return run


def write(pages: DataFrame, folder: str, least: int = 0) -> list[dict]:
    """Archives of all pages in folder; a row (path, n_records, n_bytes) for each file."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("_key", F.sha2(F.col("html").cast("binary"), 256))
    keys = slim.where(F.octet_length("html") >= least).select("_key", "page_id")
    firsts = keys.groupBy("_key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("_n")).where("_n > 1 AND first_id IS NOT NULL").select("_key", "first_id")
    # ids alone meet on a payload's key, which many pages may share; texts are dealt by key and id
    later = keys.distinct().join(firsts, "_key").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(F.col("_key").alias("_k"), F.coalesce("page_id", F.lit(0)).alias("_p"), F.col("page_id").isNull().alias("_none"), "first_id")
    own = (F.col("_key") == F.col("_k")) & (F.coalesce("page_id", F.lit(0)) == F.col("_p")) & (F.col("page_id").isNull() == F.col("_none"))
    rows = slim.join(later, own, "left").select("page_id", "url", "html", "first_id", F.col("first_id").isNotNull().alias("refers"))
    return [r.asDict() for r in sorted(rows.mapInArrow(_spark.bounded(_writer(folder)), "path string, n_records long, n_bytes long").collect())]


_READ = "path string, at long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, gap_bytes long, gap_why string, payload string"


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with _spark.opened(path) as f:
                    for kind, x in salvaged(Source(f)):
                        if kind == "gap":
                            a, z, why = x
                            rows.append((path, a, None, None, None, None, None, None, z - a, why, None))
                        else:
                            head, payload, at = x
                            revisit = head.get("warc-type") == "revisit"
                            digest = head.get("warc-payload-digest", "")
                            text = payload.decode("utf-8", "replace") if payloads and not revisit else None
                            size += len(text or "")
                            rows.append((path, at, number(head.get("warc-page-id")), head.get("warc-target-uri"), head.get("warc-type"), number(head.get("warc-payload-length")) if revisit else len(payload), digest[5:] if revisit else payload_digest(payload), number(head.get("warc-refers-to-page-id")), None, None, text))
                        if len(rows) >= 512 or size >= _spark.BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])


def read(spark: SparkSession, paths: list[str], payloads: bool = True) -> DataFrame:
    """Every record that can be read, and a row with gap_bytes and gap_why for each quarantined stretch. paths: one for each file."""
    if not paths:
        return spark.createDataFrame([], _READ)
    rows = spark.sparkContext.parallelize([(x,) for x in paths], len(paths))
    return spark.createDataFrame(rows, "path string").mapInArrow(_spark.bounded(_reader(payloads)), _READ)


def records(archive: DataFrame) -> DataFrame:
    return archive.where(F.col("gap_bytes").isNull())


def quarantine(archive: DataFrame) -> DataFrame:
    return archive.where(F.col("gap_bytes").isNotNull()).select("path", "at", "gap_bytes", "gap_why")
