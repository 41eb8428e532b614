"""WARC archives with segmented records, written and reassembled.

Writing: equal payloads are found by their SHA-1; the row with the largest
page_id is a response, others are revisits of it, so that a payload is stored
once. A response is an HTTP message in chunked framing; blocks over
SEGMENT_BYTES become a first segment and continuation records. Every record is
a gzip member. A task writes archives under names of its own; the manifest
table names those that count.

Reading: every archive is inflated once, into a table of records; only segments
are then shuffled, by origin identifier, put in order by segment number, and checked for
gaps and for the total length that the last one states; then the chunked
framing is decoded and the payload's digest checked. A group is one record.

Defined results: null html is an empty payload; rows without page_id are
revisits where a row with one has their payload, else responses; rows that
repeat the largest page_id of a payload are all responses; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [payload[k : k + CHUNK_BYTES] for k in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
        if body[at - 2 : at] != b"\r\n" or len(out[-1]) != size:
            raise ValueError("broken chunk")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def _members(row: dict, sha: str) -> Iterator[bytes]:
    """The records of one page."""
    payload = (row["html"] or "").encode("utf-8")
    url = (row["url"] or "urn:unknown").replace("\r", "%0D").replace("\n", "%0A")
    name = f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response")]
    if row["page_id"] is not None:
        common.append(("Page-ID", str(row["page_id"])))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if row["refers_to"] is not None:
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("Refers-To-Page-ID", str(row["refers_to"]))], f"{http}Content-Length: {len(payload)}\r\n\r\n".encode())
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    cuts = range(0, len(block), SEGMENT_BYTES)
    for k, at in enumerate(cuts, 1):
        part = block[at : at + SEGMENT_BYTES]
        if k == 1:
            yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(cuts) else []
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)), *last], part)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns the manifest: path, n_records."""
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    shared = rows.groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    shared = runtime.written(shared, folder, "shared")
    shared = runtime.if_small(shared)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    rows = rows.join(shared, "sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n = None, "", 0, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    path = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
                    fs, where = runtime.open_fs(path)
                    out, n = fs.open_output_stream(where, compression=None), 0
                    size = out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: cohortloom\r\nformat: WARC File Format 1.1\r\n"))
                for member in _members(row, digest((row["html"] or "").encode("utf-8"))):
                    size += out.write(member)
                    n += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield done()
        if out is not None:
            out.close()
            yield done()

    return runtime.written(rows.mapInArrow(run, "path string, n_records long"), folder, "manifest")


def _stream(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive; a member at a time is in memory."""
    rest = b""
    while True:
        expand, data = zlib.decompressobj(31), []
        while not expand.eof:
            if not rest:
                rest = file.read(1 << 20)
                if not rest:
                    if data:
                        raise ValueError("the archive ends within a record")
                    return
            data.append(expand.decompress(rest))
            rest = expand.unused_data
        record = b"".join(data)
        end = record.index(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in record[:end].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        block = record[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("a record is shorter than it says")
        yield headers, block


def payload_of(block: bytes, claimed: str) -> bytes:
    """The payload of a whole HTTP message in chunked framing, its digest checked."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest(payload) != claimed:
        raise ValueError("the payload's digest is another")
    return payload


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (segment number, total length or None, bytes), in any order: no gap, no repeat, and the length that is stated."""
    segments = sorted(segments, key=lambda s: s[0])
    block = b"".join(s[2] for s in segments)
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1][1] != len(block):
        raise ValueError("segments are missing, repeated or of another length")
    return block


#: Records, and bytes of them, that go to Spark at once.
BATCH_RECORDS, BATCH_BYTES = 256, 8 << 20
_TYPES = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def read_archives(manifest: DataFrame, id_type: str = "bigint", folder: str | None = None) -> DataFrame:
    """page_id, payload (binary; null for revisits), payload_bytes, payload_digest, record_type, refers_to of every page in the archives.

    folder: where the table of records goes.
    """
    folder = folder or runtime.work_folder(manifest.sparkSession, "records")
    id_arrow = _TYPES[id_type]
    integer = lambda v: None if v is None else int(v)
    name = (lambda v: v) if id_type == "string" else integer
    page = [("page_id", id_arrow), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", id_arrow)]
    part = [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64())]

    def batch(rows: list[tuple], fields) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

    def batched(rows: Iterator[tuple], fields, bulk: int) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r[bulk] or b"")
            if len(held) == BATCH_RECORDS or size >= BATCH_BYTES:
                yield batch(held, fields)
                held, size = [], 0
        if held:
            yield batch(held, fields)

    def parsed(path: str) -> Iterator[tuple]:
        """A row a record: whole ones with their payload, segments (segment is not null) with their block."""
        fs, where = runtime.open_fs(path)
        with fs.open_input_stream(where, compression=None) as file:
            for h, block in _stream(file):
                claimed, kind = h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), h["WARC-Type"]
                if "WARC-Segment-Number" in h:
                    yield name(h.get("Page-ID")), block, None, claimed, "response", None, h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), int(h["WARC-Segment-Number"]), integer(h.get("WARC-Segment-Total-Length"))
                elif kind == "revisit":
                    size = int(dict(x.split(": ", 1) for x in block.decode().split("\r\n")[1:] if x)["Content-Length"])
                    yield name(h.get("Page-ID")), None, size, claimed, kind, name(h.get("Refers-To-Page-ID")), None, None, None
                elif kind != "warcinfo":
                    payload = payload_of(block, claimed)
                    yield name(h.get("Page-ID")), payload, len(payload), claimed, kind, None, None, None, None

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                yield from batched(parsed(path), [*page, *part], 1)

    def joined(batches):
        def rows():
            for b in batches:
                for k in range(b.num_rows):  # a group at a time as Python objects
                    row = b.slice(k, 1).to_pylist()[0]
                    payload = payload_of(reassemble([(s["segment"], s["total"], s["payload"]) for s in row["segments"]]), row["claimed"])
                    yield row["page_id"], payload, len(payload), row["claimed"], "response", None

        yield from batched(rows(), page, 1)

    whole_type = f"page_id {id_type}, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}"
    files = manifest.select("path").repartition(max(1, manifest.count()))
    records = runtime.written(files.mapInArrow(read, f"{whole_type}, origin string, segment int, total long"), folder, "records")
    segments = records.where("segment is not null").groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("payload_digest").alias("claimed"), F.collect_list(F.struct("segment", "total", "payload")).alias("segments"))
    return records.where("segment is null").select([n for n, _ in page]).union(segments.mapInArrow(joined, whole_type))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """read_archives() of write_archives() of pages."""
    folder = folder or runtime.work_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), pages.schema["page_id"].dataType.simpleString(), folder)
