"""WARC archives with an index written first, and coalesced byte-range reads.

Writing: each task appends gzip members, one record each, to an archive of its own in the shared folder and emits an
index row (offset, length, URL, digest) per record; the index is a table, so only archives of successful attempts are
ever named.  Reading: index rows are sorted by archive and offset, neighbouring ranges become one read, and records
are parsed from those bytes.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import drop_staged, fresh_path, lean, stage, utf8

REVISIT_MIN = 1000
READ_MAX, GAP_MAX = 4 << 20, 1 << 16
#: Compressed bytes of archives that one reading task gets.
READ_PARTITION = 16 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"
INDEX = "page_id {kind}, url string, archive string, offset long, length long, digest string, record_type string, refers_to {kind}"


def record(page_id, url: str | None, body: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that keeps the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = head if refers_to is not None else head + body
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The named fields, HTTP head and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    return {"fields": fields, "payload": body, "payload_bytes": size}


def _squeeze(raw: bytes) -> bytes:
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


def _writer(folder: str):
    """Rows (page_id, url, html, digest, refers_to) to index rows; the archive lies in ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, digest, refers_to, body in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), utf8(b.column(2))):
                    member = _squeeze(record(page_id, url, body, digest, refers_to))
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    rows.append((page_id, url, f"{folder}/{name}", at, len(member), digest, "response" if refers_to is None else "revisit", refers_to))
                    at += len(member)
                kind = b.schema.field(0).type
                kinds = [kind, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind]
                columns = list(zip(*rows)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "archive", "offset", "length", "digest", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_min: int = REVISIT_MIN) -> DataFrame:
    """Write a record per row and return the index table.

    Of records with equal payloads of at least ``revisit_min`` bytes, those with the largest id are responses and
    the others revisit it.
    """
    src = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    body = F.coalesce(F.col("html"), F.lit(""))
    src = src.withColumn("digest", F.sha1(body.cast("binary")))
    long = src.filter(F.octet_length(body) >= revisit_min).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    keepers = stage(spark, long.filter("n > 1").select("digest", "keeper"), "warc-keepers")  # staged, the join can split a hot payload
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper")), F.col("keeper")).alias("refers_to")
    rows = src.join(keepers, "digest", "left").select("page_id", "url", "html", "digest", refers_to)
    kind = src.schema["page_id"].dataType.simpleString()
    index = stage(spark, rows.mapInArrow(lean(_writer(fresh_path(spark, "warc"))), INDEX.format(kind=kind)), "warc-index")
    drop_staged(spark, keepers)
    return index


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(first, last) runs of sorted ranges to read at once."""
    first = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] - sum(rows[i - 1]) > GAP_MAX or sum(rows[i]) - rows[first][0] > READ_MAX:
            yield first, i
            first = i


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted index rows (page_id, archive, offset, length, refers_to) to what their records say."""
    name, source = None, None
    for b in batches:
        page_ids, archives, offsets, lengths, refers = (b.column(i).to_pylist() for i in range(5))
        out = []
        at = 0
        while at < len(archives):
            end = at
            while end < len(archives) and archives[end] == archives[at]:
                end += 1
            if archives[at] != name:
                name = archives[at]
                fs, path = pafs.FileSystem.from_uri(name)
                source = fs.open_input_file(path)
            own = list(zip(offsets[at:end], lengths[at:end]))
            for lo, hi in _ranges(own):
                base = own[lo][0]
                raw = source.read_at(sum(own[hi - 1]) - base, base)
                for i in range(lo, hi):
                    off, size = own[i]
                    got = parse(zlib.decompress(raw[off - base : off - base + size], 31))
                    fields, kind = got["fields"], got["fields"]["WARC-Type"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Record-ID"] != f"<{_URN}{page_ids[at + i]}>":
                        raise ValueError("the index points at another record")
                    if kind == "response" and (hashlib.sha1(got["payload"]).hexdigest() != digest or len(got["payload"]) != got["payload_bytes"]):
                        raise ValueError("a record's payload does not match its digest")
                    if kind == "revisit" and fields["WARC-Refers-To"] != f"<{_URN}{refers[at + i]}>":
                        raise ValueError("a revisit refers to another record than the index says")
                    out.append((page_ids[at + i], got["payload_bytes"], digest, kind, refers[at + i] if kind == "revisit" else None))
            at = end
        key = b.schema.field(0).type
        kinds = [key, pa.int64(), pa.string(), pa.string(), key]
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(index: DataFrame) -> DataFrame:
    """Read the records that index rows select, by coalesced ranges in archive order."""
    kind = index.schema["page_id"].dataType.simpleString()
    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-size // READ_PARTITION))
    ordered = index.select("page_id", "archive", "offset", "length", "refers_to").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(lean(_reader), f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")


def warc_round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a WARC record, then read the archives back.

    Defined cases: NULL html is an empty payload; a NULL URL has no target field; a row with a NULL id revisits the
    largest id of its payload, or is a response where all are NULL; rows repeating the largest id are responses all;
    other columns are not read; an empty table writes no archive.
    """
    return read_archives(write_archives(spark, pages, id_col, url_col, html_col))
