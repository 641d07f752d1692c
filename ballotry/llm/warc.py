"""Operator 5: writing and reading WARC archives.

Writing: a page becomes one WARC record, and a record one gzip member. Of pages with
the same payload of at least REVISIT_BYTES bytes the one with the smallest id is a
response and the others are revisits that refer to it; the smallest id of each digest
comes from a pre-aggregated count, and a hot digest's rows are split by Spark's skew
join. Every task writes its own archives to the shared folder under a name of its own,
moved into place when complete, so a task that runs again replaces the same files.

Reading: one archive is one task. It is read in order, in pieces, each member inflated
as its bytes arrive; the header gives the length of the block, the HTTP header in the
block the payload; lengths and SHA-256 digests are verified, and what is cut off, too
long or altered raises ValueError.

Defined cases: null html is an empty payload; a null url has no target header; control
characters in a url are percent-escaped; a null page_id is a response unless its payload
has another holder with an id; rows that repeat the smallest id of a group are all
responses; an empty table writes no archive and reads no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, filesystem, new_folder, slices

#: Smaller payloads are always responses. Size at which an archive is closed. Bytes read at a time.
REVISIT_BYTES, ARCHIVE_BYTES, PIECE = 100, 256 << 20, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_references(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", other.alias("refers_to"))


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one WARC record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if refers_to is not None else http + html
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, digest, refers_to) to archives in folder; (path, records,
    bytes) of each archive."""

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), []
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, records, size = None, 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            path = f"{root}/part-{task.partitionId():06d}-{len(made):04d}.warc.gz"
            if fs.get_file_info(path).type != 0:
                fs.delete_file(path)
            fs.move(temporary, path)
            made.append((f"{folder}/{path.rpartition('/')[2]}", records, size))
            out = None

        for b in slices(batches):
            for row in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    temporary, records, size = f"{root}/.task-{task.taskAttemptId()}-{len(made)}", 0, 0
                    out = fs.open_output_stream(temporary, compression=None)
                page_id, url, html, *rest = row
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = member.compress(record(page_id, url, html.encode(), *rest)) + member.flush()
                out.write(data)
                records, size = records + 1, size + len(data)
                if size > ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        paths, counts, sizes = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return cut(rows.mapInArrow(save, "path string, records long, bytes long"))


def inflated(pieces: Iterable[bytes]) -> Iterator[tuple[bytes, bool]]:
    """The content of a file of gzip members as (bytes, does the member end here)."""
    member, begun = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            data = member.decompress(piece)
            begun = True
            piece = member.unused_data if member.eof else b""
            yield data, member.eof
            if member.eof:
                member, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the last member is cut off")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def read_records(pieces: Iterable[bytes], with_payload: bool = False) -> Iterator[tuple[dict[str, str], int, str, bytes]]:
    """(header, payload bytes, payload digest, payload or b"") of each record in order.
    A block goes through the digests as it arrives and is kept only if asked for."""
    held, head = bytearray(), None
    for data, ends in inflated(pieces):
        held += data
        if head is None and (at := held.find(b"\r\n\r\n")) >= 0:
            head = fields(bytes(held[:at]))
            if not head[""].startswith("WARC/"):
                raise ValueError("no WARC record where one should begin")
            del held[: at + 4]
            left, block, payload, http, n, kept = int(head["content-length"]), hashlib.sha256(), hashlib.sha256(), bytearray(), None, []
        if head is not None:
            part = bytes(held[:left])
            del held[: len(part)]
            left -= len(part)
            block.update(part)
            if n is None:
                http += part
                if (at := http.find(b"\r\n\r\n")) >= 0:
                    part, n = bytes(http[at + 4 :]), 0
                    web = fields(bytes(http[:at]))
            if n is not None:
                payload.update(part)
                n += len(part)
                if with_payload:
                    kept.append(part)
        if ends:
            if head is None or left or held != b"\r\n\r\n" or n is None:
                raise ValueError("a record's length is not its content's")
            if head["warc-block-digest"] != f"sha256:{block.hexdigest()}":
                raise ValueError(f"the block of {head['warc-record-id']} was altered")
            digest = head["warc-payload-digest"].removeprefix("sha256:")
            if head["warc-type"] == "response" and (digest != payload.hexdigest() or n != int(web["content-length"])):
                raise ValueError(f"the payload of {head['warc-record-id']} was altered")
            yield head, int(web["content-length"]), digest, b"".join(kept)
            head = None
            held.clear()


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives (path): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null unless with_payload)."""
    number = lambda name: None if name is None or name == "<urn:page:null>" else int(name[len("<urn:page:") : -1])
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_stream(at, compression=None) as f:
                    rows, size = [], 0
                    for head, n, digest, payload in read_records(iter(lambda f=f: f.read(PIECE), b""), with_payload):
                        rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), n, digest, head["warc-type"], number(head.get("warc-refers-to")), payload if with_payload and head["warc-type"] == "response" else None))
                        size += len(payload)
                        if len(rows) == 2000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("path").mapInArrow(load, schema)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to archives in folder (a new shared one unless given) and read them back."""
    archives = write(with_references(pages), folder or new_folder(spark, "warc"))
    return read(archives.repartition(max(1, archives.count())))
