"""WARC archives: writing with revisits and segments, reading, reassembly.

Writing: a row becomes one record, or a first record and continuations when its block is larger than
a segment. Every record is a gzip member of its own, so archives can be sought by member. Members go
out through Spark's text writer, some to a row, whose line end is an empty gzip member; so files reach
any store Spark writes to and survive lost tasks. An archive is cut by bytes (FILE_ROWS x ROW_BYTES).

Reading: archives are inflated and parsed piece by piece by Content-Length; a task holds one archive
as stored (below 2 GB, Spark's limit for a binary file) and one record. A record whose header has no
valid length is reported as ``invalid`` and reading goes on at the next record line.

Segments of one origin meet by their origin id, in order of segment number; the total length is
verified, chunked transfer framing is decoded, and the payload is checked against its digest (SHA-256
or SHA-1; others are not checked). Numbers that are none, records cut short and different segments
of one number make the payload incomplete. One payload is the most a task holds beyond its batch.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.scratch import cut, new_path

SEGMENT, CHUNK, LEAST_REVISIT = 16 << 10, 4096, 100
ROW_BYTES, FILE_ROWS = 1 << 20, 96  # an archive has at most so many rows of so many bytes, and a record more in each
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, uri string, page_id long, refers_to long, digest string, origin string, segment int, total long, block binary"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
STEP, FEED, HEADER, BAD = 1 << 20, 1 << 13, 1 << 20, (1 << 31) - 1  # BAD: a segment number that cannot be
_SIZE = re.compile(rb"[0-9A-Fa-f]{1,15}")
_WHOLE = re.compile(r"-?[0-9]{1,19}")


def member(data: bytes) -> bytes:
    """A gzip member; the same bytes give the same member."""
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = member(b"")


def record_id(page_id: int | None, place: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{place}'.encode()).digest())}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if its framing is broken or ends before its closing line."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0 or not _SIZE.fullmatch(text := body[at:end].split(b";")[0].strip(b" \t")):
            return None
        size, at = int(text, 16), end + 2
        if size == 0:
            while (end := body.find(b"\r\n", at)) > at:  # trailer fields
                at = end + 2
            return b"".join(out) if end == at and end + 2 == len(body) else None
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return member(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def _records(segment: int):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for page, url, payload, digest, revisit, first_page in zip(*(c for c in batch.columns), strict=True):
                page, digest, row = page.as_py(), digest.as_py(), row + 1
                own = record_id(page, f"{task}/{row}")
                common = [("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", _one_line(url.as_py() or "") or None), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page)]
                if revisit.as_py():
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", first_page.as_py()), ("Content-Type", "application/http; msgtype=response")], head)
                    continue
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload.as_py())
                parts = [block[i : i + segment] for i in range(0, len(block), segment)]
                kind = ("Content-Type", "application/http; msgtype=response")
                yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Number", 1 if len(parts) > 1 else None), kind], parts[0])
                for n, part in enumerate(parts[1:], 2):
                    again = record_id(page, f"{task}/{row}#{n}")
                    yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", again), *common[:2], ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole records, about ROW_BYTES each, so that rows count bytes."""
        held, size = [], 0
        for record in members(batches):
            held.append(record)
            size += len(record)
            if size >= ROW_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment: int = SEGMENT) -> None:
    """Write a record per row. Of rows with equal payloads of at least LEAST_REVISIT bytes those with the
    smallest id are responses and the others revisit that page; record ids are unique to each row."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    big = rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("digest", "page_id")
    first = big.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").select("digest", "first_page")
    full = rows.join(cut(first, "first"), "digest", "left")
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    full = full.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), "first_page")
    out = full.mapInArrow(_records(segment), "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", FILE_ROWS).text(path)


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of an archive in pieces; a broken gzip stream ends it."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + STEP] for i in range(0, len(data), STEP))
        return
    view, at = memoryview(data), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        while not z.eof:
            part = view[at : at + FEED]  # what a member leaves over is copied, so little is fed at a time
            try:
                piece = z.decompress(part, STEP)
            except zlib.error:
                return
            used = len(part) - len(z.unused_data) - len(z.unconsumed_tail)
            at += used
            if piece:
                yield piece
            elif not used and not z.eof:
                return


class _Stream:
    """Bytes of an archive, as many as are asked for at a time."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.at = iter(pieces), bytearray(), 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at > STEP:
            del self.held[: self.at]
            self.at = 0
        self.held += piece
        return True

    def reach(self, n: int) -> int:
        """How many of the next n bytes there are."""
        while len(self.held) - self.at < n and self.more():
            pass
        return min(n, len(self.held) - self.at)

    def find(self, what: bytes, limit: int) -> int:
        """Bytes before the next ``what``, -1 if it does not come within the limit."""
        seen = 0
        while True:
            found = self.held.find(what, self.at + max(0, seen - len(what)))
            if found >= 0:
                return found - self.at
            seen = len(self.held) - self.at
            if seen > limit or not self.more():
                return -1

    def take(self, n: int) -> bytes:
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out


def _number(text: str | None, low: int, high: int, bad: int | None) -> int | None:
    if text is None:
        return None
    return int(text) if _WHOLE.fullmatch(text) and low <= int(text) <= high else bad


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple]:
    """The records of an archive's content as tuples in the order of RECORD."""
    s = _Stream(pieces)
    while True:
        while s.reach(2) == 2 and s.held[s.at : s.at + 2] == b"\r\n":
            s.take(2)
        if not s.reach(1):
            return
        end = s.find(b"\r\n\r\n", HEADER)
        head = s.take(end if end >= 0 else 0)
        fields: dict[str, str] = {}
        for line in head.split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        size = _number(fields.get("content-length"), 0, 1 << 40, None)
        valid = head[:5] == b"WARC/" and size is not None
        if valid:
            s.take(4)
            block = s.take(s.reach(size))
            kind, segment = fields.get("warc-type"), _number(fields.get("warc-segment-number"), 1, BAD - 1, BAD)
            if len(block) < size:
                segment = BAD
        else:
            kind, segment, block = "invalid", BAD, b""
        page = lambda name: _number(fields.get(name), -(1 << 63), (1 << 63) - 1, None)
        total = _number(fields.get("warc-segment-total-length"), 0, 1 << 50, -1)
        yield (
            fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), page("x-page-id"), page("x-refers-to-page-id"),
            (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None, fields.get("warc-segment-origin-id"), segment, total, block,
        )
        if not valid:
            next_ = s.find(b"\r\n\r\nWARC/", 1 << 62)
            if next_ < 0:
                return
            s.take(next_ + 4)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))])
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for r in parse_records(inflated(content.as_py())):
                rows.append(r)
                size += len(r[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: columns of RECORD."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, RECORD)


def _agrees(digest: str, payload: bytes) -> bool:
    """Whether a payload has the digest; algorithms other than SHA-256 and SHA-1 are taken on trust."""
    name, sep, value = digest.partition(":")
    if not sep:
        return hashlib.sha256(payload).hexdigest() == digest.lower()
    if name.lower() == "sha1":
        own = hashlib.sha1(payload)
        return value.lower() in (own.hexdigest(), base64.b32encode(own.digest()).decode().lower())
    return True


PAYLOAD = "record_id string, type string, uri string, page_id long, refers_to long, digest string, complete boolean, payload binary"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records sorted by origin and segment, or unsegmented ones, to payloads."""
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in PAYLOAD.split(", ")]
    out: list[tuple] = []
    held: list[dict] = []
    size = 0

    def close() -> None:
        nonlocal size
        if not held:
            return
        head = held[0]
        segmented = head["segment"] is not None or head["type"] == "continuation"
        block = b"".join(r["block"] for r in held)
        total = held[-1]["total"]
        whole = not segmented or (head["type"] != "continuation" and [r["segment"] for r in held] == list(range(1, len(held) + 1)) and total == len(block))
        header, gap, body = block.partition(b"\r\n\r\n")
        payload = body
        if not gap:
            payload = block
        elif b"transfer-encoding: chunked" in header.lower():
            payload = dechunked(body)
            whole = whole and payload is not None
        if whole and head["digest"] and head["type"] == "response":
            whole = _agrees(head["digest"], payload)
        keep = payload if whole and head["type"] == "response" else None
        out.append((head["record_id"], head["type"], head["uri"], head["page_id"], head["refers_to"], head["digest"], whole, keep))
        size += len(keep or b"")
        held.clear()

    def flush() -> pa.RecordBatch:
        nonlocal size
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        out.clear()
        size = 0
        return batch

    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(j)[i].as_py() for j, n in enumerate(NAMES)}
            same = held and r["type"] == "continuation" and r["origin"] in (held[0]["record_id"], held[0]["origin"])
            again = held and r["record_id"] == held[0]["record_id"] and len(held) == 1
            if (same or again) and all(r[k] == held[-1][k] for k in ("segment", "total", "block")):
                continue  # a repeated record; a different one of the same number breaks the count
            if not same:
                close()
            held.append(r)
            if size > 4 << 20:
                yield flush()
    close()
    if out:
        yield flush()


def reassemble(records: DataFrame) -> DataFrame:
    """One row per record that is no continuation, and one for continuations whose first record is missing.

    ``complete``: numbers run from 1 without gap, lengths sum to the stated total, framing decodes and
    the digest agrees. ``payload`` is null for revisits and for anything incomplete.
    """
    single = records.where("segment is null and not type <=> 'continuation'").mapInArrow(_joined, PAYLOAD)
    parts = records.where("segment is not null or type <=> 'continuation'").withColumn("_at", F.coalesce("origin", "record_id"))
    parts = parts.repartition("_at").sortWithinPartitions("_at", F.col("type") == "continuation", "segment").select(*NAMES)
    return single.unionByName(parts.mapInArrow(_joined, PAYLOAD))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives, read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null payloads are empty. Rows repeated with one id are records of their own, and if that id is the
    smallest of its payload all of them are responses. Ids have the whole range of a long. A null id is larger than any other, and equal to
    null. Revisits take their length from the response they refer to, whose digest must agree. Other columns are not read; an empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, payload_col)
    got = reassemble(cut(read_warc(spark, path), "parsed"))
    got = got.select("record_id", "page_id", "type", "refers_to", "digest", "complete", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    got = cut(got, "records")
    answers = got.where("type = 'response'")
    asked = got.where("type = 'revisit'")
    target = answers.select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("digest")).distinct()
    revisits = asked.drop("payload_bytes", "payload_digest").join(cut(target, "answers"), ["refers_to", "digest"], "left")
    revisits = revisits.select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    return answers.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
