"""WARC archives of pages: written one gzip member per record, and read one after the other.

Pages with equal payloads are stored once: the one with the largest number is a response, the
others are revisits that refer to it and hold its digest, not its payload.  Who refers to whom
is found on digests and numbers alone; payloads are shuffled only if the table of repeated
digests is too large to be sent to all tasks.

The reader takes an archive in pieces of bounded size and decompresses a member with a zlib
stream of its own.  Where the member ends the record must end.  Headers end at the first empty
line, the block after `Content-Length` bytes, and two line ends close the record; SHA-1 is
taken as the bytes come by, of the block and, from the end of its HTTP headers on, of the
payload.  So a record of any size is checked in constant memory; only a caller who wants
payloads gets them whole.

Files lie in a shared folder of any kind that Arrow opens (local, HDFS, S3, GCS, Azure).  A
task that runs again writes files of other names; only the files whose names the successful
attempt returned are read.

Cases: a null page is an empty payload; a null URL is left out, control characters, blanks
and others that are not ASCII are percent-encoded; pages without a number are responses that
nothing refers to; repeated rows that tie for the largest number are all responses; no rows
give no rows.  A record that breaks a rule is a row with `problem`; if its member is broken,
the archive ends there, as nothing says where the next one begins.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindsight.llm.shared import sent_if_small, settle
from hindsight.session import shared_folder

# Format version, profile of a revisit, media types.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
FIELDS = "application/warc-fields"

#: Bytes that are read from a file, and decompressed, at once; most bytes of headers.
CHUNK = 1 << 16
DECOMPRESSED = 1 << 20
MOST_HEADERS = 1 << 20


def digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page: int | None, sha1: bytes) -> str:
    """A URN for a page of a payload, from which the page's number can be read again.

    A UUID of version 8 has 122 free bits: the number's 64, then 58 of the digest.
    """
    tail = int.from_bytes(sha1[:8], "big") >> 6
    if page is None:
        return f"urn:uuid:{uuid.UUID(bytes=sha1[:16], version=5)}"
    free = (page % (1 << 64)) << 58 | tail
    bits = free >> 74 << 80 | 8 << 76 | (free >> 62 & 0xFFF) << 64 | 2 << 62 | free & (1 << 62) - 1
    return f"urn:uuid:{uuid.UUID(int=bits)}"


def page_of(urn: str | None) -> int | None:
    """The number in a `record_id`, None if there is none."""
    try:
        bits = uuid.UUID((urn or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if bits >> 76 & 0xF != 8:
        return None
    number = (bits >> 80) << 16 | (bits >> 64 & 0xFFF) << 4 | bits >> 58 & 0xF
    return number - (1 << 64) if number >> 63 else number


def _fields(pairs: list[tuple[str, object]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None)


def member(kind: str, urn: str, date: str, block: list[bytes], more: list[tuple[str, object]], level: int) -> bytes:
    """A record as a gzip member; the block comes in parts."""
    whole = hashlib.sha1()
    for part in block:
        whole.update(part)
    head = VERSION + b"\r\n" + _fields([
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{urn}>"), ("WARC-Date", date), *more,
        ("WARC-Block-Digest", f"sha1:{digest(whole.digest())}"), ("Content-Length", sum(map(len, block))),
    ]) + b"\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([*[z.compress(part) for part in (head, *block, b"\r\n\r\n")], z.flush()])


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int) -> bytes:
    """The response, or if it refers to a page the revisit, of a payload."""
    sha1 = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\n" + _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    more: list[tuple[str, object]] = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest(sha1)}"), ("Content-Type", HTTP)]
    if refers_to is None:
        return member("response", record_id(page, sha1), date, [http, payload], more, level)
    more += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{record_id(refers_to, sha1)}>"), ("WARC-Refers-To-Date", date)]
    return member("revisit", record_id(page, sha1), date, [http], more, level)


def write_warc(
    pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0, archive_bytes: int = 1 << 30, level: int = 6
) -> DataFrame:
    """Write pages (page_id, url, html) into archives; (path, records, bytes) of each, settled.

    Payloads of at least `least_bytes` are stored once.  A task writes its pages in their
    order and begins a new archive after `archive_bytes`.
    """
    body = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    key = F.when(F.col("page").isNotNull() & (F.octet_length("payload") >= least_bytes), F.unhex(F.sha2("payload", 256)))
    keyed = rows.withColumn("key", key)
    repeated = keyed.where("key IS NOT NULL").groupBy("key").agg(F.max("page").alias("last"), F.min("page").alias("first"))
    repeated = settle(repeated.where("first < last").drop("first"))
    marked = keyed.join(sent_if_small(repeated), "key", "left")
    marked = marked.select("page", "url", "payload", F.when(F.col("page") < F.col("last"), F.col("last")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out = None
        records = size = 0

        def begin():
            name = f"{uuid.uuid4().hex}.warc.gz"
            store.create_dir(base, recursive=True)
            info = member("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, [_fields([("format", "WARC File Format 1.1")])], [("WARC-Filename", name), ("Content-Type", FIELDS)], level)
            stream = store.open_output_stream(f"{base}/{name}", compression=None)
            stream.write(info)
            return stream, name, len(info)

        def row() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    out, name, size = begin()
                    records = 0
                found = page_record(*r, date, level)
                out.write(found)
                records, size = records + 1, size + len(found)
                if size >= archive_bytes:
                    yield row()
                    out = None
        if out is not None:
            yield row()

    return settle(marked.mapInArrow(write, "path string, records long, bytes long"))


class _Problem(ValueError):
    """A record breaks a rule."""


@dataclass
class Record:
    """What a record says, and what its bytes are."""

    offset: int
    keep: bool
    version: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytearray = field(default_factory=bytearray)
    payload_bytes: int = 0
    payload_digest: str | None = None
    problem: str | None = None

    def __post_init__(self):
        self._head, self._http = bytearray(), bytearray()
        self._left: int | None = None
        self._tail = bytearray()
        self._block, self._sha1 = hashlib.sha1(), hashlib.sha1()
        self._in_payload = False

    def feed(self, data: bytes) -> None:
        """Take the next bytes of the member."""
        if self._left is None:
            self._head += data
            end = self._head.find(b"\r\n\r\n")
            if end < 0:
                if len(self._head) > MOST_HEADERS:
                    raise _Problem("headers do not end")
                return
            data = bytes(self._head[end + 4 :])
            self._read_headers(bytes(self._head[:end]))
            self._head.clear()
        block, rest = data[: self._left], data[self._left :]
        self._left -= len(block)
        self._block.update(block)
        self._read_block(block)
        self._tail += rest
        if len(self._tail) > 4:
            raise _Problem("the record is longer than its Content-Length")

    def _read_headers(self, head: bytes) -> None:
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/1."):
            raise _Problem("it does not begin with a WARC version")
        self.version = first
        name = None
        for line in lines:
            if line[:1] in (" ", "\t") and name:
                self.headers[name] += " " + line.strip()
                continue
            name, colon, value = line.partition(":")
            name = name.strip().lower()
            if not colon or not name:
                raise _Problem("a header has no name")
            self.headers[name] = value.strip()
        length = self.headers.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise _Problem("Content-Length is no number")
        self._left = int(length)
        http = self.headers.get("content-type", "").replace(" ", "").lower()
        self._in_payload = not http.startswith("application/http")

    def _read_block(self, data: bytes) -> None:
        if not self._in_payload:
            self._http += data
            end = self._http.find(b"\r\n\r\n")
            if end < 0:
                if len(self._http) > MOST_HEADERS:
                    raise _Problem("HTTP headers do not end")
                return
            data = bytes(self._http[end + 4 :])
            del self._http[end:]
            self._in_payload = True
        self._sha1.update(data)
        self.payload_bytes += len(data)
        if self.keep:
            self.payload += data

    def close(self) -> None:
        """Check what can be known at the end of the member."""
        if self._left is None:
            raise _Problem("headers do not end")
        if self._left:
            raise _Problem("the record is shorter than its Content-Length")
        if self._tail != b"\r\n\r\n":
            raise _Problem("two line ends do not close the record")
        if not self._in_payload:
            raise _Problem("HTTP headers do not end")
        self._same("warc-block-digest", digest(self._block.digest()))
        if self.headers.get("warc-type") == "revisit":
            # the payload is elsewhere; its size and digest are what the headers say
            named = [line.partition(":") for line in self._http.decode("latin-1").split("\r\n")]
            sizes = [v.strip() for k, _, v in named if k.strip().lower() == "content-length"]
            if sizes and not (sizes[0].isascii() and sizes[0].isdigit()):
                raise _Problem("the HTTP Content-Length is no number")
            self.payload_bytes = int(sizes[0]) if sizes else 0
            self.payload_digest = self._stated("warc-payload-digest")
        else:
            self.payload_digest = digest(self._sha1.digest())
            self._same("warc-payload-digest", self.payload_digest)

    def _stated(self, name: str) -> str | None:
        kind, _, value = self.headers.get(name, "").partition(":")
        return value.upper() if kind.lower() == "sha1" else None

    def _same(self, name: str, found: str) -> None:
        if (stated := self._stated(name)) not in (None, found):
            raise _Problem(f"{name} is {stated}, the bytes have {found}")


def records(stream, keep: bool) -> Iterator[Record]:
    """The records of an archive in their order; `stream` has `read(size)`."""
    data, offset = b"", 0
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            return
        record, z, full = Record(offset, keep), zlib.decompressobj(31), False
        try:
            while not z.eof:
                if not data and not full:
                    data = stream.read(CHUNK)
                    if not data:
                        raise zlib.error("the archive ends within a member")
                before = len(data)
                out = z.decompress(data, DECOMPRESSED)
                full = len(out) == DECOMPRESSED
                data = z.unused_data if z.eof else z.unconsumed_tail
                offset += before - len(data)
                if record.problem is None:
                    try:
                        record.feed(out)
                    except _Problem as problem:
                        record.problem = str(problem)
            if record.problem is None:
                record.close()
        except _Problem as problem:
            record.problem = str(problem)
        except zlib.error as error:
            record.problem = f"broken member: {error}"
            yield record
            return
        yield record


COLUMNS = (
    "path string, offset long, type string, record_id string, date string, target_uri string, refers_to string, "
    "headers map<string,string>, payload_bytes long, payload_digest string, problem string"
)


def read_warc(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives (path): COLUMNS, and with `payloads` the payload; an archive is one task's."""
    schema = COLUMNS + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in COLUMNS.replace("string,string", "").split(", ")] + (["payload"] if payloads else [])
    types = [pa.int64() if n in ("offset", "payload_bytes") else pa.map_(pa.string(), pa.string()) if n == "headers" else pa.binary() if n == "payload" else pa.string() for n in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as stream:
                    for r in records(stream, payloads):
                        h = r.headers
                        row = (path, r.offset, h.get("warc-type"), h.get("warc-record-id", "").strip("<>") or None, h.get("warc-date"), h.get("warc-target-uri"),
                               h.get("warc-refers-to", "").strip("<>") or None, list(h.items()), r.payload_bytes, r.payload_digest, r.problem)
                        out.append((*row, bytes(r.payload)) if payloads else row)
                        held += len(r.payload)
                        if len(out) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return archives.select("path").mapInArrow(read, schema)


def _pages(numbers: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in numbers:
        own, other = ([page_of(u) for u in batch.column(c).to_pylist()] for c in ("record_id", "refers_to"))
        rest = [batch.column(c) for c in ("payload_bytes", "payload_digest", "type", "problem")]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *rest, pa.array(other, pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "problem", "refers_to"])


def archived_pages(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from archives of `pages`.

    The archives stay in `folder`, below the cluster's shared one unless given.  A record that
    breaks a rule is an error.
    """
    spark = pages.sparkSession
    written = write_warc(pages, folder or f"{shared_folder(spark)}/warc", **how)
    found = read_warc(written).where("type IS NULL OR type <> 'warcinfo'")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, problem string, refers_to long"
    rows = found.select("record_id", "refers_to", "payload_bytes", "payload_digest", "type", "problem").mapInArrow(_pages, schema)
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("unsound record: "), "problem")).cast("string")).otherwise(F.col("record_type"))
    return rows.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")
