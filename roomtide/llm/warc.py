"""WARC archives written and read by Spark: one gzip member per record.

Writing: equal payloads are found by digest, the first of them becomes a
``response`` record and the others ``revisit`` records that refer to it. Tasks
turn their rows into archives of bounded size, and Spark's own file writer puts
each into a file, so its commit protocol covers retried tasks and any file
system that Spark can reach will do. An empty gzip member ends every archive,
which tells a whole archive from one that was cut short.

Reading: Spark deals out the archive files; a sequential reader inflates a
member piece by piece, takes the block by its content length, checks that
nothing but the closing line breaks follows, and compares the digests.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import quote_from_bytes, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from roomtide.llm.common import named, portable
from roomtide.session import fresh_path

portable(__name__)

# Fixed values of the format.
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK, END_OF_HEADER = b"\r\n", b"\r\n\r\n"
GZIP = 16 + zlib.MAX_WBITS

REVISIT_FROM = 100  # payloads of fewer bytes are always stored
ARCHIVE_BYTES = 16 << 20  # an archive is closed once it has so many bytes
PIECE = 1 << 16  # bytes inflated at a time
SALTS = 16  # parts over which the rows of one payload are spread
DATE = "1970-01-01T00:00:00Z"

RECORD = (
    "archive string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, "
    "payload binary, payload_bytes bigint, payload_digest string, verified boolean, error string"
)


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    return packer.compress(data) + packer.flush()


END_MARK = member(b"")


# --- writing ----------------------------------------------------------------

def uri_of(record_id: str | None) -> bytes:
    return b"urn:page:" + quote_from_bytes((record_id or "").encode()).encode()


def header(fields: Iterable[tuple[str, bytes]]) -> bytes:
    return b"".join(name.encode() + b": " + value + BREAK for name, value in fields)


def record(record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One uncompressed record; a revisit keeps the headers of its answer and leaves out the payload."""
    block = b"HTTP/1.1 200 OK\r\n" + header([
        ("Content-Type", b"text/html; charset=utf-8"), ("Content-Length", str(len(payload)).encode()),
    ]) + BREAK
    if refers_to is None:
        block += payload
    target = quote_from_bytes(url.encode(), safe="".join(map(chr, range(33, 127)))).encode() if url else uri_of(record_id)
    fields = [
        ("WARC-Type", b"response" if refers_to is None else b"revisit"),
        ("WARC-Record-ID", b"<" + uri_of(record_id) + b">"),
        ("WARC-Date", date.encode()),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", b"sha256:" + digest.encode()),
        ("WARC-Block-Digest", b"sha256:" + hashlib.sha256(block).hexdigest().encode()),
        ("Content-Type", b"application/http; msgtype=response"),
        ("Content-Length", str(len(block)).encode()),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", b"<" + uri_of(refers_to) + b">"), ("WARC-Profile", IDENTICAL.encode())]
    return VERSION + BREAK + header(fields) + BREAK + block + END_OF_HEADER


def archiver(archive_bytes: int, date: str):
    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns):
                members.append(member(record(*(value.as_py() for value in row), date)))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield pa.record_batch({"archive": pa.array([b"".join(members)], pa.binary())})
                    members, size = [], 0
        if members:
            yield pa.record_batch({"archive": pa.array([b"".join(members)], pa.binary())})

    return archives


def with_originals(pages: DataFrame, key: str, url: str, payload: str, revisit_from: int) -> DataFrame:
    """``id, url, payload, digest, refers_to`` as ``record`` takes them.

    Rows of one payload may be a third of all: their smallest id is found with
    partial sums, and joined back over ``SALTS`` parts of each payload's rows.
    """
    rows = pages.select(
        named(key).alias("id"), named(url).cast("string").alias("url"),
        F.coalesce(named(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.select(
        "*", F.sha2("payload", 256).alias("digest"), (F.octet_length("payload") >= revisit_from).alias("long")
    )
    shared = rows.where("long").groupBy("digest").agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("n"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    shared = shared.where("n > 1").select("digest", "original", salts)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    later = F.col("id").isNull() | (F.col("id") > F.col("original"))
    return rows.join(shared, ["digest", "salt"], "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest",
        F.when(later, F.col("original")).cast("string").alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE,
) -> None:
    """Write one record per row to archives in the new folder ``path``.

    The payload is the text in UTF-8, null as empty. Of rows with equal payloads
    of ``revisit_from`` bytes or more, the one with the smallest id is stored;
    repeated rows of that id are all stored, as no id may refer to itself. A
    null id comes after all others and is written as an empty one; where all ids
    of a payload are null, all rows are stored. A null or empty url is replaced
    by the record's own name; blanks, control characters and what is not ASCII
    are percent-encoded in it. Other columns are ignored. An empty table gives
    a folder without archives. An archive is closed at ``archive_bytes``, so
    memory follows that bound and the longest payload.
    """
    records = with_originals(pages, key, url, payload, revisit_from)
    archives = records.mapInArrow(archiver(archive_bytes, date), "archive binary")
    # one row a file; the text writer ends a row with the empty member
    writer = archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1)
    writer.option("encoding", "ISO-8859-1").option("lineSep", END_MARK.decode("latin-1")).text(path)


# --- reading ----------------------------------------------------------------

class BadArchive(ValueError):
    pass


class Member:
    """One gzip member of ``data`` from ``at`` on, inflated as far as it is asked for."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.buffer = data, at, bytearray()
        self.unpacker = zlib.decompressobj(GZIP)

    def more(self) -> bool:
        """Inflate about one piece; false when the member is at its end."""
        while not self.unpacker.eof:
            feed = self.unpacker.unconsumed_tail or self.data[self.at:self.at + PIECE]
            fresh = not self.unpacker.unconsumed_tail
            if not len(feed):
                raise BadArchive("the archive ends inside a member")
            try:
                out = self.unpacker.decompress(feed, PIECE)
            except zlib.error as error:
                raise BadArchive(f"not a gzip member: {error}") from None
            if fresh:
                self.at += len(feed)
            if self.unpacker.eof:
                self.at -= len(self.unpacker.unused_data)
            if out:
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """All bytes up to ``mark``, which is left out."""
        seen = 0
        while (found := self.buffer.find(mark, seen)) < 0:
            seen = max(len(self.buffer) - len(mark) + 1, 0)
            if not self.more():
                raise BadArchive("the member ends inside a header")
        head = bytes(self.buffer[:found])
        del self.buffer[:found + len(mark)]
        return head

    def exactly(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, piece by piece."""
        while size:
            if not self.buffer and not self.more():
                raise BadArchive("the block is shorter than its content length")
            piece = bytes(self.buffer[:size])
            del self.buffer[:size]
            size -= len(piece)
            yield piece


class Block:
    """The block of a record under its content length, as a member of its own that keeps a digest."""

    def __init__(self, source: Member, size: int):
        self.pieces, self.digest, self.buffer = source.exactly(size), hashlib.sha256(), b""

    def __iter__(self) -> Iterator[bytes]:
        for piece in self.pieces:
            self.digest.update(piece)
            yield piece

    def until(self, mark: bytes) -> tuple[bytes, bytes]:
        """Bytes before ``mark``, and those already read behind it."""
        head = b""
        for piece in self:
            head += piece
            if mark in head:
                return tuple(head.split(mark, 1))
        raise BadArchive("the block ends inside its header")


def fields_of(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and named fields of a header; names in lower case."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"not a header line: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    return first, fields


def length_in(fields: dict[str, str]) -> int:
    size = fields.get("content-length", "")
    if not size.isdecimal():
        raise BadArchive("no content length")
    return int(size)


def named_by(uri: str | None) -> str | None:
    return None if uri is None else unquote(uri.strip("<>").removeprefix("urn:page:"))


def digest_in(fields: dict[str, str], name: str) -> str:
    scheme, _, value = fields.get(name, "").partition(":")
    return value.lower() if scheme.lower() == "sha256" else ""


def read_record(source: Member, with_payload: bool) -> dict:
    """The record of one member; it must end with the member."""
    first, fields = fields_of(source.until(END_OF_HEADER))
    if not first.startswith("WARC/"):
        raise BadArchive(f"not a record: {first[:40]!r}")
    kind = fields.get("warc-type")
    block = Block(source, length_in(fields))
    kept, size, digest = [], 0, hashlib.sha256()
    answer = {}
    if kind in ("response", "revisit") and fields.get("content-type", "").startswith("application/http"):
        head, rest = block.until(END_OF_HEADER)
        answer = fields_of(head)[1]
    else:
        rest = b""
    for piece in chain([rest], block):
        digest.update(piece)
        size += len(piece)
        if with_payload:
            kept.append(piece)
    if b"".join(source.exactly(len(END_OF_HEADER))) != END_OF_HEADER or source.buffer or source.more():
        raise BadArchive("the record does not end where its content length says")
    claimed = digest_in(fields, "warc-payload-digest")
    verified = block.digest.hexdigest() == digest_in(fields, "warc-block-digest")
    if kind == "revisit":  # its payload is elsewhere: the headers tell size and digest
        verified, size, found = verified and size == 0 and bool(claimed), length_in(answer), claimed
    else:
        found = digest.hexdigest()
        verified = verified and found == claimed
    return {
        "record_type": kind, "record_id": named_by(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"),
        "refers_to": named_by(fields.get("warc-refers-to")), "payload": b"".join(kept) if with_payload and kind != "revisit" else None,
        "payload_bytes": size, "payload_digest": found, "verified": verified,
    }


def records(data: bytes, with_payload: bool = True) -> Iterator[dict]:
    """All records of an archive; a last row with ``error`` if it is damaged or has no end mark. No bytes, no records."""
    data, at = memoryview(data), 0
    while len(data):
        source = Member(data, at)
        try:
            if not source.more():  # an empty member: the end mark
                if source.at != len(data):
                    raise BadArchive("bytes follow the end mark")
                return
            yield {"offset": at, **read_record(source, with_payload)}
        except BadArchive as error:
            yield {"offset": at, "verified": False, "error": str(error)}
            return
        at = source.at


def reader(with_payload: bool, names: list[str], types: list[pa.DataType]):
    schema = pa.schema(list(zip(names, types)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                rows, size, path = [], 0, path.as_py()
                for row in records(content.as_buffer(), with_payload):
                    rows.append({"archive": path, **row})
                    size += 512 + len(row.get("payload") or b"")
                    if size >= PIECE * 16:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``: where it is, its header fields, payload, size and digest.

    ``verified`` says that the digests of block and payload are right; a revisit
    has no payload of its own and tells size and digest of the one it refers to.
    Where an archive is damaged or has no end mark, its last row has ``error``
    and the records before it are returned. A folder without archives gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(field.split() for field in RECORD.split(", ")))
    return files.mapInArrow(reader(with_payload, list(names), [kinds[t] for t in types]), RECORD)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return what stands in them; a broken record is an error."""
    spark = pages.sparkSession
    path = fresh_path(spark)
    write_archives(pages, path)
    found = read_archives(spark, path, with_payload=False)
    broken = F.raise_error(F.concat_ws(" ", F.lit("broken record:"), "archive", "offset", "error"))
    return found.select(
        F.when(F.col("verified"), F.col("record_id").try_cast("bigint")).otherwise(broken.cast("bigint")).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("bigint").alias("refers_to"),
    )
