"""WARC archives: writing, reading, segment reassembly and chunked transfer framing.

Writing: of pages with equal payloads one is a ``response`` record and the others ``revisit`` it. Long
HTTP blocks are framed in chunks and split into segments: a first record with segment number 1 and
``continuation`` records that name it as their origin, the last of which gives the total length.
Every record is a gzip member of its own, so a reader can seek to it; Spark's text writer puts the members
into files of bounded size, with the member of the two line ends that close a record as separator.

Reading: files are parsed record by record; segments are grouped by origin, ordered by number and
verified against the total length; chunked framing is decoded and digests are verified.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 32 * 1024, 8 * 1024, 2000
VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: The address of a page that has none: WARC asks for one in every record of a page.
NO_URL = "urn:x-page:"


def member(data: bytes) -> bytes:
    """A gzip member, without a time, so that a second try of a task writes the same."""
    return gzip.compress(data, 6, mtime=0)


#: The separator as the text writer takes it: one character for each byte.
SEPARATOR = member(END.encode()).decode("latin-1")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, url, payload_digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{payload_digest}').urn}>"


def frame_chunks(payload: bytes, chunk_bytes: int) -> bytes:
    parts = []
    for at in range(0, len(payload), chunk_bytes):
        piece = payload[at : at + chunk_bytes]
        parts.append(b"%x\r\n%s\r\n" % (len(piece), piece))
    return b"".join(parts) + b"0\r\n\r\n"


def unframe_chunks(body: bytes) -> bytes:
    """The payload of a chunked body. Chunk extensions and trailers are skipped. A body that breaks off raises ValueError."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if at + size > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk breaks off")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("latin-1").strip().lower()] = value.decode("latin-1").strip()
    if fields.get("transfer-encoding", "").lower() == "chunked" and body:
        body = unframe_chunks(body)
    return fields, body


def _header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields if value is not None), f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode()


def _one_line(value) -> str:
    """A header value: line ends and other control characters would break the header."""
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in str(value))


def page_records(page_id, url, payload: bytes, response_page, response_url, is_response: bool, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the line ends that close a record."""
    digest = digest_of(payload)
    me = record_id(page_id, url, digest)
    target = ("WARC-Target-URI", f"{NO_URL}{page_id}" if url is None else _one_line(url))
    about = [("WARC-Date", DATE), target, ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if not is_response:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
        other = [("WARC-Refers-To", record_id(response_page, response_url, digest)), ("WARC-Profile", REVISIT_PROFILE)]
        yield _header([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *about, *other], block) + block
        return
    chunked = len(payload) > chunk_bytes
    framing = "Transfer-Encoding: chunked" if chunked else f"Content-Length: {len(payload)}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{framing}{END}".encode() + (frame_chunks(payload, chunk_bytes) if chunked else payload)
    if len(block) <= segment_bytes:
        yield _header([("WARC-Type", "response"), ("WARC-Record-ID", me), *about], block) + block
        return
    starts = range(0, len(block), segment_bytes)
    for number, at in enumerate(starts, 1):
        piece = block[at : at + segment_bytes]
        if number == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", me), *about, ("WARC-Segment-Number", 1)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(me, number, digest)), ("WARC-Date", DATE), target, ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", number)]
            fields += [("WARC-Segment-Total-Length", len(block))] * (number == len(starts))
        yield _header(fields, piece) + piece


def _records(batches: Iterator[pa.RecordBatch], segment_bytes: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    info = b"software: hatlake\r\nformat: WARC File Format 1.1"
    named = f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'part {TaskContext.get().partitionId()}').urn}>"
    out, held = [member(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", named), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info) + info)], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for record in page_records(*row, segment_bytes, chunk_bytes):
                out.append(member(record))
                held += len(out[-1])
            if held > 4 << 20:
                yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
                out, held = [], 0
    if out:
        yield pa.record_batch([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record for each row to gzip WARC files below ``path``.

    Null bodies are empty payloads. Of equal payloads of at least ``least_bytes`` bytes the row with the
    largest id is the response (null ids are smaller than others); rows that repeat it are responses too.
    """
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(body_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    known = F.struct(F.col("page").isNotNull().alias("known"), "page", "url")
    # Narrow rows only, summed in each task first, so a hot payload is no more than one row for each task.
    groups = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.count("*").alias("n"), F.max(known).alias("top")).filter("n > 1")
    groups = materialise(groups.select(F.col("key").alias("group_key"), "top"))
    joined = rows.join(groups, F.col("key") == F.col("group_key"), "left")
    first = F.col("top").isNull() | (F.col("page").eqNullSafe(F.col("top.page")) & F.col("url").eqNullSafe(F.col("top.url")))
    ready = joined.select("page", "url", "payload", F.col("top.page").alias("top_page"), F.col("top.url").alias("top_url"), first.alias("first"))
    records = ready.mapInArrow(partial(_records, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes), "record binary")
    # The bytes go out as they are: the cast doesn't decode, and the writer copies. The encoding is that of the separator.
    out = records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1")
    out.option("maxRecordsPerFile", records_per_file).text(path)


RECORD = "type string, record_id string, page string, uri string, refers_to string, payload_digest string, segment int, origin string, total long, block binary, block_ok boolean"
_FIELDS = ("warc-type", "warc-record-id", "warc-page-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "warc-segment-number", "warc-segment-origin-id", "warc-segment-total-length")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("a block breaks off")
        yield fields, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = lambda x: None if x is None else int(x)
    kinds = [pa.string()] * 6 + [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch_of(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for i in range(batch.num_rows):
            content = batch.column(0)[i].as_buffer()
            rows, held = [], 0
            with io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content)), 1 << 16) as stream:
                for f, block in parse_records(stream):
                    if f["warc-type"] == "warcinfo":
                        continue
                    kind, me, page, uri, refers, digest, number, origin, total = (f.get(x) for x in _FIELDS)
                    uri = None if uri and uri.startswith(NO_URL) else uri
                    rows.append((kind, me, page, uri, refers, digest and digest.removeprefix("sha1:"), whole(number), origin, whole(total), block, f.get("warc-block-digest") == f"sha1:{digest_of(block)}"))
                    held += len(block)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``; see ``RECORD``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_parse, RECORD)


PAGE = "page string, record_id string, type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, ok boolean"


def _assemble(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in PAGE.split(", ")]
    for batch in batches:
        rows = []
        for page, me, kind, uri, refers, digest, total, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by_number = {p["segment"]: p["block"] for p in pieces}
            copies = sum(p["segment"] == min(by_number) for p in pieces)
            block = b"".join(by_number[n] for n in sorted(by_number))
            ok = sorted(by_number) == list(range(1, len(by_number) + 1)) and all(p["block_ok"] for p in pieces) and (total is None and len(by_number) == 1 or total == len(block))
            payload, n_bytes = None, None
            try:
                fields, payload = http_payload(block)
                n_bytes = len(payload)
                if kind == "revisit":
                    n_bytes = int(fields["content-length"])
                else:
                    ok &= digest is None or digest == digest_of(payload)
                    digest = digest_of(payload)
            except (ValueError, KeyError):
                ok = False
            rows += [(page, me, kind, uri, refers, digest, n_bytes, payload if with_payload else None, bool(ok))] * copies
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def reassemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per original record; see ``PAGE``.

    Records without a segment number pass as they are and aren't shuffled. Segments are grouped by
    origin (a group is one HTTP block), put in order and joined. ``ok`` is false if a segment is
    missing, lengths or digests differ, or chunked framing breaks off; the row stays, so nothing is lost
    silently. Continuations without their first record give a row of type ``continuation``. Segments that
    are there several times, as of repeated rows, give as many rows.
    """
    piece = F.struct(F.coalesce("segment", F.lit(1)).alias("segment"), "block", "block_ok")
    about = ["page", "record_id", "type", "uri", "refers_to", "payload_digest"]
    whole = records.filter("segment IS NULL").select(*about, F.lit(None).cast("long").alias("total"), F.array(piece).alias("pieces"))
    of_first = [F.min_by(c, "segment").alias(c) for c in about]
    split = records.filter("segment IS NOT NULL").groupBy(F.coalesce("origin", "record_id").alias("key")).agg(*of_first, F.max("total").alias("total"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    return whole.unionByName(split.drop("key")).mapInArrow(partial(_assemble, with_payload=with_payload), PAGE)


def page_report(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write ``pages`` to archives below ``path``, read them back, and report page_id, payload_bytes, payload_digest, record_type, refers_to, ok."""
    write_archives(pages, path, **options)
    kind = pages.schema[options.get("id_col", "page_id")].dataType
    rows = materialise(reassemble(read_records(pages.sparkSession, path), with_payload=False).drop("payload"))
    # one row for each response that is revisited, whatever the number of its copies
    originals = rows.filter("type = 'response'").groupBy(F.col("record_id").alias("original")).agg(F.first("page").alias("original_page"))
    joined = rows.join(materialise(originals), F.col("refers_to") == F.col("original"), "left")
    return joined.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("original_page").cast(kind).alias("refers_to"), (F.col("ok") & (F.col("refers_to").isNull() | F.col("original").isNotNull())).alias("ok"))
