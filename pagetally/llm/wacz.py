"""Web archives packed as ZIP files: written by tasks, read back by byte ranges.

An archive is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz`` holds
one gzip member per WARC record, ``indexes/index.cdxj`` a line per record with its offset and
length, ``datapackage.json`` the name of both. Of pages with equal payloads the one with
the smallest id is a response record, the others are revisit records without a payload.

The reader parses the end record, the ZIP64 end record where there is one, and the central
directory, finds where a stored member's bytes begin, lists the records by the index and then
reads each record's own byte range; nothing is unpacked to disk. Listing is one small row per
record, so records of one large archive are read by many tasks.

Archives are written through pyarrow's file systems (local, HDFS, S3, GCS) to the shared
folder. A task that is repeated writes a new file; only files in the returned table count.

Defined results: a null payload is empty; a null page id sorts after all others, and where
all ids of a payload are null every record is a response; rows that repeat the smallest id
of a payload are all responses; a null URL leaves its header out; an empty table gives no
archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import id_type, partitions_of, record_batch
from pagetally.session import shared_dir
from pagetally.sources.tables import materialize

DATA = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
PACKAGE = "datapackage.json"
# The tables have no crawl time.
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LIST_AT_ONCE = 10_000
# Records of so many bytes of an archive are read by one task.
READ_TOGETHER = 4 << 20

# Signatures and sizes of ZIP structures.
END, END_SIZE = b"PK\x05\x06", 22
END64_LOCATOR, END64_LOCATOR_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
MAX_COMMENT = 0xFFFF
ZIP64_EXTRA = 1
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: str | None, digest: str) -> str:
    return f"<urn:page:{urllib.parse.quote(page, safe='')}>" if page is not None else f"<urn:no-page:{digest}>"


def _page(urn: str | None) -> str | None:
    prefix = "<urn:page:"
    return urllib.parse.unquote(urn[len(prefix):-1]) if urn and urn.startswith(prefix) else None


def warc_record(
    page: str | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: str | None,
) -> bytes:
    """One record as a gzip member; without a payload it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # Control characters would end the header.
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    if payload is None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
              f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


@dataclass(frozen=True)
class Record:
    kind: str
    page: str | None
    url: str | None
    payload_bytes: int
    digest: str
    refers_to: str | None
    payload: bytes | None


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode().partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(member: bytes) -> Record:
    """Read a gzip member back and check its lengths and digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _headers(lines)
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("a WARC record has a wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    promised = int(_headers(http.split(b"\r\n")[1:])["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != promised or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    return Record(
        kind, _page(fields["warc-record-id"]), fields.get("warc-target-uri"), promised, digest,
        _page(fields.get("warc-refers-to")), payload if kind == "response" else None)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


class ZipFile:
    """Members of a ZIP file, from its directories; reads ranges of a seekable file."""

    def __init__(self, file, size: int):
        self.file = file
        self.members = {m.name: m for m in self._directory(size)}

    def range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("a ZIP file ends too early")
        return data

    def _directory(self, size: int) -> Iterator[Member]:
        start = max(0, size - END_SIZE - MAX_COMMENT)
        tail = self.range(start, size - start)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("not a ZIP file")
        count, length, begin = struct.unpack_from("<10xHII", tail, at)
        locator = start + at - END64_LOCATOR_SIZE
        if locator >= 0 and (FULL16 == count or FULL32 in (length, begin)):
            found = self.range(locator, END64_LOCATOR_SIZE)
            if found[:4] == END64_LOCATOR:
                end64 = self.range(struct.unpack_from("<8xQ", found)[0], END64_SIZE)
                if end64[:4] != END64:
                    raise ValueError("a ZIP64 end record is missing")
                count, length, begin = struct.unpack_from("<32xQQQ", end64)
        data, at = self.range(begin, length), 0
        for _ in range(count):
            if data[at:at + 4] != ENTRY:
                raise ValueError("a ZIP directory is damaged")
            method, packed, full, names, extras, comments, header = struct.unpack_from("<10xH8xIIHHH8xI", data, at)
            at += ENTRY_SIZE
            name, extra = data[at:at + names], data[at + names:at + names + extras]
            at += names + extras + comments
            # A ZIP64 field holds, in this order, those of the three that did not fit.
            wide = self._zip64(extra)
            if full == FULL32:
                full, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            if packed == FULL32:
                packed, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            if header == FULL32:
                header = struct.unpack_from("<Q", wide)[0]
            yield Member(name.decode(), method, packed, header)

    @staticmethod
    def _zip64(extra: bytes) -> bytes:
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == ZIP64_EXTRA:
                return extra[at + 4:at + 4 + size]
            at += 4 + size
        return b""

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        member = self.members[name]
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed, so its records cannot be read by range")
        head = self.range(member.header_at, LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ValueError(f"{name} has no local header")
        names, extras = struct.unpack_from("<26xHH", head)
        return member.header_at + LOCAL_SIZE + names + extras, member.size


def _open(path: str):
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system, inner


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Write every page as a record; returns (path, size, n_records), one row per archive."""
    folder = folder or shared_dir(pages.sparkSession, "archives")
    rows = pages.select(
        pages[id_col].alias("id"), pages[id_col].cast("string").alias("page"),
        pages[url_col].cast("string").alias("url"), pages[payload_col].cast("binary").alias("payload"))
    kind = id_type(pages, id_col)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Response records are made here, so only compressed payloads are shuffled."""
        for batch in batches:
            found, sizes, records = [], [], []
            for page, url, payload in zip(*(batch.column(c) for c in ("page", "url", "payload")), strict=True):
                data = payload.as_py() or b""
                found.append(payload_digest(data))
                sizes.append(len(data))
                records.append(warc_record(page.as_py(), url.as_py(), found[-1], len(data), data, None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("page"), batch.column("url"), pa.array(found, pa.string()),
                 pa.array(sizes, pa.int64()), pa.array(records, pa.binary())],
                ["id", "page", "url", "digest", "size", "record"])

    def only_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [p.as_py() or b"" for p in batch.column("payload")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([payload_digest(p) for p in payloads], pa.string()),
                 pa.array([len(p) for p in payloads], pa.int64())], ["id", "digest", "size"])

    firsts = materialize(
        rows.select("id", "payload").mapInArrow(only_digests, f"id {kind}, digest string, size long")
        .groupBy("digest", "size").agg(F.min("id").alias("first")), "firsts")
    made = rows.mapInArrow(
        digests, f"id {kind}, page string, url string, digest string, size long, record binary")
    joined = made.join(firsts, ["digest", "size"]).select(
        "page", "url", "digest", "size", "record",
        F.when(F.col("id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first").cast("string"))
        .alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, archive, member, index, at, n = "", None, None, [], 0, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page", "url", "digest", "size", "record", "refers_to")]
            for page, url, digest, size, record, refers_to in zip(*columns, strict=True):
                if archive is None:
                    path = f"{folder}/{uuid.uuid4().hex}.wacz"
                    system, inner = _open(path)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(inner)
                    archive = zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = archive.open(DATA, "w", force_zip64=True)
                data = record.as_py() if not refers_to.is_valid else warc_record(
                    page.as_py(), url.as_py(), digest.as_py(), size.as_py(), None, refers_to.as_py())
                member.write(data)
                index.append((url.as_py() or "-", at, len(data)))
                at, n = at + len(data), n + 1
        if archive is None:
            return
        member.close()
        lines = sorted(f"{urllib.parse.quote(u, safe=':/')} {DATE} " + json.dumps(
            {"offset": str(o), "length": str(s), "filename": DATA.rpartition("/")[2]}) for u, o, s in index)
        archive.writestr(INDEX, "\n".join(lines) + "\n")
        archive.writestr(PACKAGE, json.dumps(
            {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}))
        archive.close()
        stream.close()
        out = pa.schema([("path", pa.string()), ("size", pa.int64()), ("n_records", pa.int64())])
        yield record_batch(out, [[path], [system.get_file_info(inner).size], [n]])

    return materialize(joined.mapInArrow(pack, "path string, size long, n_records long"), "archive-list")


class _Forward(io.RawIOBase):
    """A stream that only goes on, so ZIP sizes are written behind the data."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def list_records(archives: DataFrame) -> DataFrame:
    """(path, at, length) of every record of the archives, from their own indexes."""
    out = pa.schema([("path", pa.string()), ("at", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = _open(path)
                with system.open_input_file(inner) as file:
                    zipped = ZipFile(file, file.size())
                    begin, _ = zipped.place(DATA)
                    lines = zipped.range(*zipped.place(INDEX)).decode().splitlines()
                for i in range(0, len(lines), LIST_AT_ONCE):
                    found = [json.loads(x[x.index("{"):]) for x in lines[i:i + LIST_AT_ONCE]]
                    yield record_batch(out, [
                        [path] * len(found), [begin + int(f["offset"]) for f in found],
                        [int(f["length"]) for f in found]])

    return archives.select("path").mapInArrow(run, "path string, at long, length long")


def read_records(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to, payload) of listed records."""
    out = pa.schema([
        ("page", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows, size = [], 0
            for own, at, length in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "length")), strict=True):
                if own != path:
                    if file is not None:
                        file.close()
                    system, inner = _open(own)
                    path, file = own, system.open_input_file(inner)
                r = parse_record(file.read_at(length, at))
                rows.append((r.page, r.url, r.payload_bytes, r.digest, r.kind, r.refers_to,
                             r.payload if with_payload else None))
                size += r.payload_bytes
                if size > 4 << 20:
                    yield record_batch(out, [list(c) for c in zip(*rows, strict=True)])
                    rows, size = [], 0
            if rows:
                yield record_batch(out, [list(c) for c in zip(*rows, strict=True)])
        if file is not None:
            file.close()

    # A fixed number of tasks: adaptive execution would judge by the few bytes of the listing.
    spread = records.repartition(
        partitions_of(records.sparkSession), "path", F.floor(F.col("at") / READ_TOGETHER)
    ).sortWithinPartitions("path", "at")
    return spread.mapInArrow(run, "page string, url string, payload_bytes long, payload_digest string, "
                                  "record_type string, refers_to string, payload binary")
