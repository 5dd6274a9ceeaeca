"""WARC archives: a writer through Spark's file sinks, and a sequential reader.

Writing. A record is one gzip member. Spark's text sink writes rows and puts a
separator after each; a gzip member of less than 16 MiB ends with a zero byte,
so rows hold members without that last byte, and the separator is a zero byte.
What arrives in the file is a plain sequence of gzip members, on whatever file
system the session writes to. A member that doesn't end with zero is followed
by an empty one, which does. Failed tasks leave nothing behind, since the
sink's commit protocol holds. A task numbers its archives by the bytes that it
has written, and begins a new one when the last has enough, whatever the sizes
of pages; the number is a partition column of the sink.

Reading. A file is read member by member: zlib takes it in steps of 64 KiB and
hands out what it has; headers end at an empty line; the content block has the
length that its header states; block and payload digests are computed from
what is read and must agree with the headers.

Duplicates. Of records with equal payloads of at least a given size, the one
with the smallest page_id is a response, all others revisit it and hold no
payload; the HTTP header that they keep states the payload's length.

Defined results: a null page's html counts as empty; null urls and page_ids
have marks of their own and come back as null; a null page_id is the largest;
rows that repeat page_id and html are all responses; an empty table gives no
rows; columns besides page_id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import scratch_path

#: Fixed values of the format.
VERSION, CRLF, GZIP_WINDOW = b"WARC/1.1", b"\r\n", 31
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 16
#: An archive is closed once it has so many bytes, so a file has at most these and one record, and a task that reads it holds no more.
FILE_BYTES = 32 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),  # the same on each run
        ("WARC-Target-URI", "urn:page:unknown" if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return VERSION + CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + block + CRLF + CRLF


def row_of(member: bytes) -> bytes:
    """A member, or a member and an empty one, less the zero byte at the end."""
    if member[-1]:
        member += gzip.compress(b"", mtime=0)
    return member[:-1]


def _rows(file_bytes: int):
    """Members, and in which of its task's archives each one goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = size = 0
        for batch in batches:
            out, held = ([], []), 0
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                raw = (row["html"] or "").encode("utf-8")
                member = row_of(gzip.compress(record(row["page_id"], row["url"], raw, row["refers_to"], row["revisit"]), 6, mtime=0))
                if size >= file_bytes:
                    archive, size = archive + 1, 0
                size += len(member) + 1
                held += len(member)
                out[0].append(archive)
                out[1].append(member)
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["archive", "member"])
                    out, held = ([], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["archive", "member"])

    return run


def digested(pages: DataFrame) -> DataFrame:
    """Add digest (SHA-1 of the html's bytes) and payload_bytes."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", "html").withColumns({"digest": F.unhex(F.sha1(raw)), "payload_bytes": F.octet_length(raw)})


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, revisit, refers_to: which records hold their payload.

    Digests are grouped within each task first, so a page with very many
    copies doesn't gather; rows meet the groups by digest, where Spark splits
    an overfull partition of rows.
    """
    rows = digested(pages)
    first = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "first")
    rows = rows.join(first, rows.digest == first.d, "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write the pages as multi-member gzip archives below ``path``, in a folder for each archive number."""
    members = with_revisits(pages, least).mapInArrow(_rows(file_bytes), "archive int, member binary")
    members.select("archive", F.col("member").cast("string").alias("member")).write.partitionBy("archive").option("lineSep", "\0").text(path)


class WarcError(ValueError):
    """An archive breaks the format or a digest."""


def members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of ``data``, one after the other."""
    at = 0
    while at < len(data):
        z, out = zlib.decompressobj(GZIP_WINDOW), []
        while not z.eof:
            if at >= len(data):
                raise WarcError("the archive ends inside a record")
            chunk = data[at : at + STEP]
            out.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
        yield b"".join(out)


def parsed(content: bytes) -> dict | None:
    """Headers, block and what follows of one record, checked; None for an empty member."""
    if not content:
        return None
    end = content.find(CRLF + CRLF)
    lines = content[:end].split(CRLF)
    if end < 0 or lines[0] != VERSION:
        raise WarcError("a record has no header")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8").partition(":") for x in lines[1:])}
    start, length = end + 4, int(head["content-length"])
    block = content[start : start + length]
    if len(block) != length or content[start + length :] != CRLF + CRLF:
        raise WarcError(f"{head['warc-record-id']}: the block isn't as long as stated")
    if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise WarcError(f"{head['warc-record-id']}: wrong block digest")
    http, _, payload = block.partition(CRLF + CRLF)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("latin-1").partition(":") for x in http.split(CRLF)[1:])}
    size, digest = int(fields["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise WarcError(f"{head['warc-record-id']}: wrong payload")
    return {"page_id": _page_of(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": _page_of(head["warc-refers-to"]) if revisit else None, "payload": payload}


_COLUMNS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    columns = _COLUMNS + [("payload", pa.binary())] * payloads
    for batch in batches:
        for i in range(batch.num_rows):
            rows: list[dict] = []
            for content in members(batch.column(0)[i].as_buffer()):
                if (row := parsed(content)) is not None:
                    rows.append(row if payloads else row | {"payload": None})
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in columns], [c for c, _ in columns])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in columns], [c for c, _ in columns])


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of all archives below ``path``, read in sequence and verified; with their payloads if asked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(lambda it: _read(it, payloads), _RECORD + ", payload binary" * payloads)


def round_trip(pages: DataFrame, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages into a fresh folder of the shared one and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, least, file_bytes)
    return read_archives(spark, path)
