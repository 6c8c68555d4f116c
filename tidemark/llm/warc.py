"""WARC archives: writing with segmented and revisit records, reading with reassembly.

A payload is wrapped in an HTTP response with chunked transfer framing. A response block longer
than ``segment_bytes`` is cut: the first segment is the response record, the others are
continuation records that name it and their number, and the last one the total length. Reading
gathers segments by origin, orders them, checks numbers and total length, takes off the HTTP head
and decodes the chunks. Segments that meet in one file are joined while it is read; only those
spread over files are shuffled, by origin. Of equal payloads of at least ``least_shared`` bytes the one with the largest
page id is stored and the others are revisit records without a payload.

Edge cases: a null html is an empty payload; a null page id is kept as null and never referred to; equal page ids
each get a record of their own; line breaks and other control characters in a url are percent-encoded; a response that lacks a
segment, or whose lengths or framing are wrong, comes back with ``complete`` false and no payload.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import file_system, new_folder, remove, written

HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
FILE_BYTES = 48_000_000
BATCH_BYTES = 8_000_000
MANIFEST = "file string, n_records bigint"
RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("complete", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ("origin", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])
RECORDS_DDL = ("page_id bigint, url string, record_type string, refers_to bigint, complete boolean, payload_bytes bigint, "
               "payload_digest string, payload binary, origin string, segment int, total_length bigint, block binary")


def to_chunks(payload: bytes, size: int) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def from_chunks(framed: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        part = framed[at:at + size]
        if len(part) < size or framed[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(part)
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP head")
    fields = [line.partition(b":") for line in head.lower().split(b"\r\n")[1:]]
    chunked = any(n.strip() == b"transfer-encoding" and b"chunked" in v for n, _, v in fields)
    return from_chunks(body) if chunked else body


def join_segments(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length, part); an error unless it is whole."""
    segments = sorted(segments, key=lambda s: s[0])
    block = b"".join(s[2] for s in segments)
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments are missing or repeat")
    if segments[-1][1] != len(block):
        raise ValueError("the total length differs")
    return block


def record(kind: str, record_id: str, block: bytes, **fields) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{n.replace('_', '-')}: {v}" for n, v in fields.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def safe_uri(url: str | None) -> str | None:
    return None if url is None else "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def page_records(page_id, url, payload: bytes, digest: str, refers_to, number: str,
                 segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """All records of one page."""
    own = f"<urn:page:{'' if page_id is None else page_id}:{number}>"
    shared = {"WARC_Target_URI": safe_uri(url), "WARC_Payload_Digest": f"sha1:{digest}"}
    http = "application/http;msgtype=response"
    if refers_to is not None:
        yield record("revisit", own, b"", **shared, WARC_Refers_To=f"<urn:page:{refers_to}>",
                     WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    block = HEAD + to_chunks(payload, chunk_bytes)
    parts = [block[at:at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record("response", own, block, **shared, Content_Type=http)
        return
    yield record("response", own, parts[0], **shared, Content_Type=http, WARC_Segment_Number=1)
    for n, part in enumerate(parts[1:], 2):
        yield record("continuation", f"{own[:-1]}:{n}>", part, WARC_Segment_Origin_ID=own, WARC_Segment_Number=n,
                     WARC_Segment_Total_Length=len(block) if n == len(parts) else None)


def shared_payloads(pages: DataFrame, least_shared: int) -> DataFrame:
    """``pages`` with payload_digest and refers_to, the largest page id of the equal payloads."""
    raw = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    large = pages.select(F.col("page_id").cast("bigint").alias("page_id"), raw.alias("payload")).where(F.length("payload") >= least_shared)
    target = (large.groupBy(F.sha1("payload").alias("payload_digest"))
              .agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n"))
    joined = rows.join(target, "payload_digest", "left")
    away = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    return joined.withColumn("refers_to", F.when(away, F.col("target"))).drop("target")


def write_archives(pages: DataFrame, folder: str, *, least_shared: int = 1000, segment_bytes: int = 32_768,
                   chunk_bytes: int = 8_192) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html), each record a gzip member; the manifest of the files."""
    def write(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        sink, name, size, count, task, number = None, "", 0, 0, uuid.uuid4().hex[:12], 0

        def closed():
            sink.close()
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([count], pa.int64())})

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))
            for row in zip(*(c.to_pylist() for c in columns)):
                number += 1
                for text in page_records(*row, f"{task}-{number}", segment_bytes, chunk_bytes):
                    if sink is None:
                        # A repeated task writes other files; only those in the manifest count.
                        name, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        sink = fs.open_output_stream(name, compression=None)
                    packer = zlib.compressobj(1, wbits=31)
                    member = packer.compress(text) + packer.flush()
                    sink.write(member)
                    size, count = size + len(member), count + 1
                    if size >= FILE_BYTES:
                        yield closed()
                        sink = None
        if sink is not None:
            yield closed()

    return written(shared_payloads(pages, least_shared).mapInArrow(write, MANIFEST), f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """Gzip members of a file, one at a time."""
    engine, parts, data = zlib.decompressobj(wbits=31), [], stream.read(1 << 20)
    while data:
        parts.append(engine.decompress(data))
        data = engine.unused_data
        if engine.eof:
            yield b"".join(parts)
            engine, parts = zlib.decompressobj(wbits=31), []
        data = data or stream.read(1 << 20)
    if any(parts):
        raise ValueError("the file ends within a record")


def parse(text: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block of one record."""
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


def page_of(identifier: str | None) -> int | None:
    number = (identifier or "").removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    return int(number) if number else None


def _response(page_id, url, segments, with_payload: bool) -> dict:
    try:
        payload = http_payload(join_segments(segments))
    except ValueError:
        return {"page_id": page_id, "url": url, "record_type": "response", "complete": False}
    return {"page_id": page_id, "url": url, "record_type": "response", "complete": True, "payload_bytes": len(payload),
            "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload if with_payload else None}


def read_file(stream, with_payload: bool) -> Iterator[dict]:
    """Rows of :data:`RECORDS`: pages, and segments whose record is not whole in this file."""
    waiting: dict[str, list] = {}
    for text in members(stream):
        fields, block = parse(text)
        kind, own, url = fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri")
        number = int(fields.get("warc-segment-number", 0))
        if kind == "revisit":
            yield {"page_id": page_of(own), "url": url, "record_type": kind, "complete": True,
                   "refers_to": page_of(fields.get("warc-refers-to")),
                   "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
        elif kind == "response" and not number:
            yield _response(page_of(own), url, [(1, len(block), block)], with_payload)
        elif kind in ("response", "continuation"):
            origin = fields.get("warc-segment-origin-id", own)
            total = fields.get("warc-segment-total-length")
            waiting.setdefault(origin, []).append((number, total and int(total), block, url))
            if len(waiting[origin]) > 1 and any(s[1] is not None for s in waiting[origin]):
                parts = [s[:3] for s in waiting[origin]]
                if sum(len(p[2]) for p in parts) >= max(p[1] or 0 for p in parts):
                    urls = [s[3] for s in waiting.pop(origin) if s[3] is not None]
                    yield _response(page_of(origin), urls[0] if urls else None, parts, with_payload)
    for origin, segments in waiting.items():
        for number, total, block, url in segments:
            yield {"page_id": page_of(origin), "url": url, "origin": origin, "segment": number,
                   "total_length": total, "block": block}


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("payload") or b"") + len(row.get("block") or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=RECORDS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=RECORDS)


def read_archives(manifest: DataFrame, folder: str, *, with_payload: bool = True) -> DataFrame:
    """One row per page record of the files in ``manifest`` (file).

    Columns: page_id, url, record_type, refers_to, complete, payload_bytes, payload_digest, payload; a revisit
    takes its length from the response it refers to.
    """
    def read(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(name, compression=None) as stream:
                    yield from _batches(read_file(stream, with_payload))

    def assemble(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        urls = [r["url"] for r in rows if r["url"] is not None]
        found = _response(rows[0]["page_id"], urls[0] if urls else None,
                          [(r["segment"], r["total_length"], r["block"]) for r in rows], with_payload)
        return pa.Table.from_pylist([found], schema=RECORDS)

    spread = manifest.select("file").repartition(max(1, manifest.count()))
    rows = written(spread.mapInArrow(read, RECORDS_DDL), f"{folder}/records")
    joined = rows.where("origin IS NOT NULL").groupBy("origin").applyInArrow(assemble, RECORDS_DDL)
    pages = rows.where("origin IS NULL").unionByName(joined).drop("origin", "segment", "total_length", "block")
    stored = (rows.where("record_type = 'response'").unionByName(joined).where("complete AND page_id IS NOT NULL")
              .groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("stored_bytes")))
    return pages.join(stored, ["refers_to", "payload_digest"], "left").withColumn(
        "payload_bytes", F.coalesce("payload_bytes", "stored_bytes")).select(
        "page_id", "url", "record_type", "refers_to", "complete", "payload_bytes", "payload_digest", "payload")


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in a new shared folder and return the digests of what they hold."""
    spark: SparkSession = pages.sparkSession
    folder = new_folder(spark, "warc")
    found = read_archives(write_archives(pages, folder, **options), folder, with_payload=False)
    result = written(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"),
                     new_folder(spark, "warc-rows"))
    remove(spark, folder)
    return result
