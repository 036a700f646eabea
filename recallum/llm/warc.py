"""WARC archives: write records, normalise monolithic gzip files, read through an index.

A writer task lays records into one whole-file gzip stream per archive.  The
normaliser inflates such a stream once, rewrites every record as its own gzip
member and gives a sidecar index of offsets, with which a reader gets at single
records.  Records with equal payloads are one `response` and `revisit` records
that refer to it.  Archives are rows of a table in the shared folder, so that
they lie in the same storage as all else and a lost executor loses none.

Defined results: a null payload counts as empty and empty payloads are equal; a
null URL is written as `urn:row:<id>`; rows that repeat an id are records each,
and all of them are the response if theirs is the smallest id; a null id is never
the smallest, unless all ids of a payload are null, which are responses then; other
columns are ignored; no rows, no archives.  The normaliser takes streams of any
number of members; a stream that ends within a record raises EOFError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from recallum.sources.shared import written

#: Uncompressed bytes after which a task starts its next archive, and compression level.
ARCHIVE, LEVEL = 4 << 20, 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WHEN = "2024-01-01T00:00:00Z"
#: A SHA-1 in base32, as `record` is given it.
SHA1 = re.compile("[A-Z2-7]{32}")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(row_id: object, url: str | None, payload: bytes, digest: str, first: object, smallest: bool) -> bytes:
    """A response record; a revisit, with the HTTP head alone, if `smallest` is not set."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{x}/{digest}')}>"
    fields = [("WARC-Type", "response" if smallest else "revisit"), ("WARC-Record-ID", name(row_id)), ("WARC-Date", WHEN), ("WARC-Target-URI", (url or f"urn:row:{row_id}").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Row", str(row_id))]
    if not smallest:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(first)), ("X-Refers-To-Row", str(first))]
        payload = b""
    fields.append(("Content-Length", str(len(head) + len(payload))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + head + payload + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]) if k}


def inflated(gz: bytes | BinaryIO, size: int = 1 << 18) -> Iterator[bytes]:
    """The content of all gzip members of a stream, one after another, in blocks of at most `size` bytes."""
    source = io.BytesIO(gz) if isinstance(gz, bytes) else gz
    d, data = None, b""
    while True:
        data = data or source.read(size)
        if d is None:
            data = data.lstrip(b"\0") if data else data  # padding between or after members
            if not data:
                if not (data := source.read(size)):
                    return
                continue
            d = zlib.decompressobj(31)
        if not data and not d.unconsumed_tail:
            raise EOFError("the archive ends within a member")
        if block := d.decompress(data, size):
            yield block
        data = d.unconsumed_tail
        if d.eof:
            data, d = d.unused_data, None


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive, by their Content-Length; one is held at a time."""
    held, need, ended = bytearray(), None, False
    while True:
        if need is None:
            # Line ends between records belong to none of them.
            while held[:2] == b"\r\n":
                del held[:2]
            if (at := held.find(b"\r\n\r\n")) >= 0:
                need = at + 4 + int(fields(bytes(held[: at + 4]))["content-length"]) + 4
        if need is not None and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            need = None
            continue
        if ended:
            if need is not None or held.strip():
                raise EOFError("the archive ends within a record")
            return
        if (block := next(blocks, None)) is None:
            ended = True
            if need is not None and len(held) >= need - 4:
                held += b"\r\n\r\n"  # the last record without its line ends
        else:
            held += block


def normalise(gz: bytes | BinaryIO, level: int = LEVEL) -> Iterator[bytes]:
    """A gzip stream of any number of members, inflated once → a gzip member for each record."""
    for r in records(inflated(gz)):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        yield c.compress(r) + c.flush()


def flagged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`pages` → (id, url, html, sha1, first): `first` is the smallest id with an equal payload.

    The smallest ids are aggregated before anything is shuffled; the join back is
    a plain equi-join, whose hot digests adaptive execution splits.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    return rows.join(rows.groupBy("sha1").agg(F.min("id").alias("first")), "sha1").select("id", "url", "html", "sha1", "first")


def write(rows: DataFrame, size: int = ARCHIVE, level: int = LEVEL) -> DataFrame:
    """Flagged rows → (archive, gz binary): monolithic archives of about `size` bytes before compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, parts = TaskContext.get().partitionId(), 0, 0, []
        c = zlib.compressobj(level, zlib.DEFLATED, 31)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:06d}.warc.gz"]), pa.array([b"".join([*parts, c.flush()])], pa.binary())], names=["archive", "gz"])

        for b in batches:
            for i, url, html, sha, first in zip(*b.columns, strict=True):
                i, first = i.as_py(), first.as_py()
                r = record(i, url.as_py(), html.as_py().encode(), base32(sha.as_py()), first, i == first)
                parts.append(c.compress(r))
                held += len(r)
                if held >= size:
                    yield close()
                    n, held, parts, c = n + 1, 0, [], zlib.compressobj(level, zlib.DEFLATED, 31)
        if held:
            yield close()

    return rows.select("id", "url", "html", "sha1", "first").mapInArrow(run, "archive string, gz binary")


def normalised(archives: DataFrame, level: int = LEVEL, size: int = ARCHIVE) -> DataFrame:
    """Monolithic archives → (archive, start, gz, offsets, lengths): a member for each record, in stretches of about `size` bytes from `start` on; offsets count from the archive's begin."""
    names = ["archive", "start", "gz", "offsets", "lengths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stretch(name: str, start: int, members: list[bytes]) -> pa.RecordBatch:
            lengths = list(map(len, members))
            offsets = [start, *(start + x for x in accumulate(lengths[:-1]))]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([start], pa.int64()), pa.array([b"".join(members)], pa.binary()), pa.array([offsets], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))], names=names)

        for b in batches:
            for name, gz in zip(*b.columns, strict=True):
                start, held, members = 0, 0, []
                for member in normalise(pa.BufferReader(gz.as_buffer()), level):
                    members.append(member)
                    held += len(member)
                    if held >= size:
                        yield stretch(name.as_py(), start, members)
                        start, held, members = start + held, 0, []
                if members:
                    yield stretch(name.as_py(), start, members)

    return archives.select("archive", "gz").mapInArrow(run, "archive string, start bigint, gz binary, offsets array<bigint>, lengths array<bigint>")


def index(archives: DataFrame) -> DataFrame:
    """Normalised archives → the sidecar: (archive, start, offset, length) of each record."""
    return archives.select("archive", "start", F.explode(F.arrays_zip("offsets", "lengths")).alias("x")).select("archive", "start", F.col("x.offsets").alias("offset"), F.col("x.lengths").alias("length"))


def read(archives: DataFrame) -> DataFrame:
    """Normalised archives → a row for each record, got by its offset: (archive, offset, row, record_type, url, payload_bytes, payload_digest, refers_to, payload binary).

    A response's bytes are counted and hashed as they are read, and the digest is theirs;
    where it or the length differs from what its headers say, ValueError is raised.  A header
    that holds no base32 SHA-1 can't be compared.  A revisit has no payload; its
    length and digest are those of its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start, gz, offsets, lengths in zip(*b.columns, strict=True):
                data, first, out = memoryview(gz.as_buffer()), start.as_py(), []
                for at, n in zip(offsets.as_py(), lengths.as_py(), strict=True):
                    r = zlib.decompress(data[at - first : at - first + n], 31)
                    body = r.index(b"\r\n\r\n") + 4
                    f = fields(r[:body])
                    block = r[body : body + int(f["content-length"])]
                    http = block.index(b"\r\n\r\n") + 4
                    size, digest = int(fields(block[:http])["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
                    payload = block[http:] if f["warc-type"] == "response" else None
                    if payload is not None:
                        said, digest = digest, base32(hashlib.sha1(payload).hexdigest())
                        if len(payload) != size or (said != digest and SHA1.fullmatch(said)):
                            raise ValueError(f"{name}: the record at {at} holds another payload than its headers say")
                    out.append((name.as_py(), at, f["x-row"], f["warc-type"], f["warc-target-uri"], size, digest, f.get("x-refers-to-row"), payload))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["archive", "offset", "row", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return archives.select("archive", "start", "gz", "offsets", "lengths").mapInArrow(run, "archive string, offset bigint, row string, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`pages` → normalised archives, written to the shared folder with a table `warc-index` of their records' offsets."""
    made = written(normalised(write(flagged(pages, id_col, url_col, html_col))), "warc")
    written(index(made), "warc-index")
    return made
