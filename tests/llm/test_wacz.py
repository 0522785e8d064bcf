"""Archives read back, against plain Python; ZIP structures of every kind."""

import base64
import gzip
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagetally.llm import wacz
from tests.llm.cases import as_set

ROWS = [
    (1, "http://a/", None), (2, None, ""), (3, "http://b/\r\nX: y", "é" * 10), (4, "u", "é" * 10),
    (None, "u", "é" * 10), (None, None, "z"), (None, "v", "z"), (7, "q", "w"), (7, "q", "w"), (8, "q", "w"),
    (9, "x", "a\r\n\r\nb" * 3), (10, "big", "x" * 3_000_000), (11, "http://ü/ space", "WARC/1.1\r\n\r\n"),
]


def expected(rows):
    ids = {}
    for page, _, text in rows:
        ids.setdefault(text or "", []).append(page)
    out = []
    for page, _, text in rows:
        data = (text or "").encode()
        first = min((p for p in ids[text or ""] if p is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        own = page == first
        out.append((page, len(data), digest, "response" if own else "revisit", None if own else first))
    return as_set(out)


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    return df.withColumns({c: F.lit("extra") for c in ("id", "digest", "path", "size", "payload", "first")})


def test_records_come_back(spark, pages):
    archives = wacz.write_archives(pages)
    rows = wacz.read_records(wacz.list_records(archives)).collect()
    number = lambda s: None if s is None else int(s)
    got = as_set((number(r.page), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows)
    assert got == expected(ROWS)
    texts = {(p, t or "") for p, _, t in ROWS}
    for r in rows:
        if r.record_type == "response":
            assert (number(r.page), r.payload.decode()) in texts
        else:
            assert r.payload is None
    assert sum(r.n_records for r in archives.collect()) == len(ROWS)


def test_archives_are_valid_for_other_readers(spark, pages):
    for row in wacz.write_archives(pages).collect():
        with zipfile.ZipFile(row.path) as zipped:
            assert zipped.testzip() is None
            assert all(i.compress_type == zipfile.ZIP_STORED for i in zipped.infolist())
            records = gzip.decompress(zipped.read(wacz.DATA))
        assert records.count(b"WARC-Record-ID") == row.n_records


def test_no_pages(spark, pages):
    assert wacz.write_archives(pages.limit(0)).isEmpty()
    assert wacz.read_records(wacz.list_records(wacz.write_archives(pages.limit(0)))).isEmpty()


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 not the end", b"c" * 65535])
@pytest.mark.parametrize("wide", [False, True])
def test_directories(comment, wide):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as zipped:
        for name in ("a", "ü/b", "empty"):
            with zipped.open(name, "w", force_zip64=wide) as member:
                member.write(b"" if name == "empty" else name.encode() * 1000)
        zipped.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        if b"PK" not in comment:
            zipped.comment = comment
    data = out.getvalue()
    found = wacz.ZipFile(io.BytesIO(data), len(data))
    for name in ("a", "ü/b"):
        assert found.range(*found.place(name)) == name.encode() * 1000
    assert found.place("empty")[1] == 0
    with pytest.raises(ValueError, match="compressed"):
        found.place("packed")


def test_zip64_directory_and_fields(monkeypatch):
    """As in files over four gigabytes: every size and place is in a ZIP64 record."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as zipped:
        for name in ("first", "second", "third"):
            with zipped.open(name, "w", force_zip64=True) as member:
                member.write(name.encode() * 50)
    data = out.getvalue()
    assert wacz.END64 in data
    found = wacz.ZipFile(io.BytesIO(data), len(data))
    assert {n: found.range(*found.place(n)) for n in found.members} == {
        n: n.encode() * 50 for n in ("first", "second", "third")}


@pytest.mark.parametrize("data", [b"", b"short", b"x" * 100_000])
def test_other_files_are_refused(data):
    with pytest.raises(ValueError, match="ZIP"):
        wacz.ZipFile(io.BytesIO(data), len(data))


def test_damaged_records_are_refused():
    good = wacz.warc_record("1", "u", wacz.payload_digest(b"page"), 4, b"page", None)
    assert wacz.parse_record(good).payload == b"page"
    for old, new in ((b"page\r\n\r\n", b"pagf\r\n\r\n"), (b"page\r\n\r\n", b"pag\r\n\r\n"), (b"WARC/1.1", b"WORC/1.1")):
        bad = gzip.compress(gzip.decompress(good).replace(old, new, 1))
        with pytest.raises(ValueError):
            wacz.parse_record(bad)
