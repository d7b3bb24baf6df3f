"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

Archives are gzip files with one member per record. Each writing task puts its share of the records into one file
of the shared folder, under a name of its own attempt, and returns what it wrote; only files that the kept list of
a finished stage names are read, so a task that is lost or runs twice leaves at most an unread file behind, which goes
with the folder. The reader streams a file: zlib decompresses member by member in blocks, Content-Length frames each record, and the
digests of block and payload are verified. It never holds more than one record.

Defined results: a null payload is empty; equal payloads below MIN_SHARED bytes are all stored; of repeated ids
each row becomes a record, and all rows with the largest id of a shared payload are stored; a null id is the smallest
and comes back as null (where all rows of a payload have none, all are stored); an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, keep, shared_folder

MIN_SHARED = 1000
BLOCK = 1 << 16
EPOCH = "1970-01-01T00:00:00Z"


class Record(NamedTuple):
    """Headers (lower-case names) and the block of one record."""

    headers: dict[str, str]
    block: bytes


class DigestError(ValueError):
    pass


def labelled_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, n_bytes: int, refers_to: int | None) -> bytes:
    """A response, or, where refers_to names the stored response, a revisit that keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", "".join((url or "").splitlines())),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
        ]
    block = http + (payload if refers_to is None else b"")
    return member([*headers, ("WARC-Block-Digest", labelled_digest(block))], block)


def _members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member of the stream an iterator over its decompressed blocks."""
    data = stream.read(BLOCK)
    while data:
        z = zlib.decompressobj(31)

        def blocks(z=z) -> Iterator[bytes]:
            nonlocal data
            while not z.eof:
                if not data:
                    raise EOFError("archive ends inside a member")
                out = z.decompress(data, BLOCK)
                data = z.unconsumed_tail or z.unused_data or (b"" if z.eof else stream.read(BLOCK))
                yield out
            data = data or stream.read(BLOCK)

        yield blocks()


def _verify(record: Record) -> None:
    said = record.headers.get("warc-block-digest")
    if said and said != labelled_digest(record.block):
        raise DigestError(f"block digest of {record.headers.get('warc-record-id')}")
    said = record.headers.get("warc-payload-digest")
    if said and record.headers.get("warc-type") == "response" and said != labelled_digest(record.block.partition(b"\r\n\r\n")[2]):
        raise DigestError(f"payload digest of {record.headers.get('warc-record-id')}")


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """Records of an archive in order; framed by Content-Length, digests verified."""
    for blocks in _members(stream):
        have = bytearray()
        while (end := have.find(b"\r\n\r\n")) < 0:
            try:
                have += next(blocks)
            except StopIteration:
                raise EOFError("member ends inside a header") from None
        version, *lines = have[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        need = int(headers["content-length"])
        del have[: end + 4]
        for x in blocks:
            have += x
            if len(have) > need + 4:
                break
        if len(have) != need + 4 or have[need:] != b"\r\n\r\n":
            raise ValueError(f"wrong framing in {headers.get('warc-record-id')}")
        record = Record(headers, bytes(have[:need]))
        _verify(record)
        yield record


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_references(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to (null: stored).

    The largest id of each shared payload is found by a partially aggregated maximum. Ids and digests alone meet under
    a digest; payloads only go by their own id and digest, so a popular payload lands in no one task."""
    body = F.encode(F.coalesce(pages[payload_col], F.lit("")), "UTF-8")
    rows = pages.select(
        pages[id_col].alias("page_id"), pages[url_col].alias("url"), body.alias("payload"), F.sha1(body).alias("payload_digest"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
    )
    large = rows.filter(F.col("payload_bytes") >= MIN_SHARED).select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"))
    shared = (
        large.groupBy("_digest").agg(F.max("_id").alias("stored_id"), F.count("*").alias("n")).filter("n > 1")
        .select(F.col("_digest").alias("shared_digest"), "stored_id")
    )
    revisits = large.join(shared, F.col("_digest") == F.col("shared_digest")).filter("stored_id is not null and not (_id <=> stored_id)")
    revisits = revisits.select("_id", "_digest", "stored_id").distinct()
    joined = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["_id"]) & (rows["payload_digest"] == revisits["_digest"]), "left")
    return joined.select(
        "page_id", "url", F.when(F.col("stored_id").isNull(), F.col("payload")).alias("payload"), "payload_digest", "payload_bytes",
        F.col("stored_id").alias("refers_to"),
    )


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_references as archives; path, n_records and n_bytes of each file."""

    def write(batches):
        out = None
        n = size = 0
        try:
            for batch in batches:
                for page_id, url, payload, digest, n_bytes, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if out is None:
                        fs, base = _file_system(folder)
                        fs.create_dir(base, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = page_record(page_id, url, payload if refers_to is None else b"", digest, n_bytes, refers_to)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})

    return rows.mapInArrow(write, "path string, n_records bigint, n_bytes bigint")


def read_archives(files: DataFrame) -> DataFrame:
    """Records of the archives that `files` (path) names: page_id, record_type, refers_to, payload_digest (bare
    lower-case hex), payload_bytes and payload (null for revisits)."""

    def rows(batches):
        import pyarrow as pa

        names = ("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        ready: list[tuple] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*ready, strict=True), types, strict=True)], names)

        number = lambda x: int(n) if x and (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = _file_system(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    for h, block in read_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n_bytes = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))[15:])
                        stored = h["warc-type"] == "response"
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        ready.append((number(h["warc-record-id"]), h["warc-type"], number(h.get("warc-refers-to")), digest, n_bytes, payload if stored else None))
                        size += len(block)
                        if size > 4 << 20 or len(ready) >= 5000:
                            yield batch()
                            ready, size = [], 0
        if ready:
            yield batch()

    return files.select("path").mapInArrow(
        rows, "page_id bigint, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
    )


def archive(
    spark: SparkSession, pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Write the pages to a folder (one of its own in the shared folder, if none is named) and return the list of
    files, which is kept: they are written once."""
    return keep(write_archives(with_references(pages, id_col, url_col, payload_col), folder or own_folder(spark)))


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = False, **columns: str) -> DataFrame:
    """Write the pages, read every archive back, one file per task, and delete the archives: the records without their
    payloads, unless these are asked for."""
    folder = own_folder(spark)
    files = archive(spark, pages, folder, **columns)
    records = read_archives(files.repartition(max(1, files.count()), "path"))
    try:
        return keep(records if with_payload else records.drop("payload"))
    finally:
        delete(spark, folder)
