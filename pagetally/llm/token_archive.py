"""Token ids in archive files, each document compressed by itself with a shared dictionary.

A document's ids, the end id included, are a little-endian array of two or four bytes an id.
Short arrays compress badly alone, so a zstandard dictionary is trained on such arrays and shared
by all files; each document is a frame of its own and can be read without its
neighbours. A file holds

    head    magic, bytes per id, SHA-256 of the dictionary
    frames  one per document, in ascending order of ids
    index   an Arrow table (id, offset, size, n_tokens) with a row per document
    tail    place and size of the index, magic

The dictionary lies beside the files under its own hash; a reader refuses one that does not
have the hash of the head. Where a file's first id stands in the whole set is known only when all
files are written, so the catalog, one row per file, says so.

Documents are dealt by ranges of their ids, so a file holds one run of the order and no task
more than its range; files end at ``file_bytes``. A task that is repeated writes a new file; only
files in the catalog count.

The dictionary is trained on at most ``SAMPLE_DOCS`` documents of at most ``SAMPLE_BYTES`` bytes,
those with the smallest hashes of their ids. It changes the size of the files and nothing else.

Ids are those of the tokenizers library without special tokens added. For a byte-level model
with the usual word pattern, texts of ASCII and Latin letters are cut into that pattern's words
here, and the library's model splits these. Others are cut where white space begins, which is
always a border for the pattern too, and the library takes the parts. The ids of up to
``REMEMBERED`` words and as many parts are kept. Texts with other white space than ASCII's or with the text of
an added token go through the library whole, and so does everything for other models.

Defined results: a null text is empty and has the end id only; ids ascend, nulls first; rows
that repeat an id follow each other by length and checksum and count one by one; an empty table
makes no files and gives no rows. Only the two columns named are read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetally.llm.common import id_type, partitions_of, record_batch
from pagetally.session import shared_dir
from pagetally.sources.tables import materialize

MAGIC = b"TOKENZ01"
HEAD, TAIL = struct.Struct("<8sB32s"), struct.Struct("<QQ8s")
FILE_BYTES = 64 << 20
FILE_DOCS = 1 << 17
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 8192
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
REMEMBERED = 1 << 19
LONG_UNIT = 48
TEXT_AT_ONCE = 1 << 20

# White space that a Unicode pattern takes for such and an ASCII one does not, or that
# versions of Unicode differ about.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u2029\u202f\u205f\u2060\u3000\ufeff]")
UNIT = re.compile(r" ?\S+|\s+(?!\S)|\s+", re.ASCII)
# The pattern's letters and numbers among the characters of PLAIN texts, whose classes are
# the same in all versions of Unicode.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+", re.ASCII)
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\u024f\u2010-\u2027\u2030-\u205e]")
CUT = re.compile(r"(?<=\S) (?=\S)", re.ASCII)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be
    seen in Latin-1, else the next one from U+0100 on."""
    spare = itertools.count(0x100)
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return [chr(b) if b in seen else chr(next(spare)) for b in range(0x100)]


class _Remembered(dict):
    """Results by text, of at most REMEMBERED short texts."""

    def __init__(self, function: Callable[[str], bytes]):
        self.function = function

    def __missing__(self, text: str) -> bytes:
        found = self.function(text)
        if len(text) <= LONG_UNIT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = found
        return found


class Encoder:
    """Id arrays of texts by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        known = json.loads(self.library.to_str())
        before, model = known["pre_tokenizer"] or {}, known["model"]
        self.by_units = (
            known["normalizer"] is None and known["post_processor"] is None and known["truncation"] is None
            and known["padding"] is None and before.get("type") == "ByteLevel" and before.get("use_regex")
            and not before.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout"))
        self.added = [t["content"] for t in known["added_tokens"]]
        characters = byte_characters()
        split, codes = self.library.model.tokenize, [
            np.array([i], self.width).tobytes() for i in range(self.library.get_vocab_size(with_added_tokens=True))]

        def word(text: str) -> bytes:
            """A word of the pattern, by the library's model alone."""
            shown = text.encode().decode("latin-1").translate(characters)
            return b"".join([codes[t.id] for t in split(shown)])

        self.words, self.units = _Remembered(word), _Remembered(self._library)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in pieces that can be encoded one by one."""
        at = 0
        while len(text) - at > TEXT_AT_ONCE and (cut := CUT.search(text, at + TEXT_AT_ONCE)):
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def __call__(self, text: str) -> bytes:
        if not self.by_units or any(t in text for t in self.added):
            return self._library(text)
        if NOT_PLAIN.search(text) is None:
            cut, of = WORD.findall, self.words.__getitem__
        elif ODD.search(text) is None:
            cut, of = UNIT.findall, self.units.__getitem__
        else:
            return self._library(text)
        return b"".join(b"".join(map(of, cut(part))) for part in self._parts(text))


@functools.cache
def encoder(path: str) -> Encoder:
    """One per process, as it remembers."""
    return Encoder(path)


def _arrays(docs: DataFrame, path: str, end_id: int, dictionary: bytes | None) -> DataFrame:
    """(id, row, n_tokens, crc, data): the id array, as a frame where a dictionary is given."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], encode.width).tobytes()
        pack = (lambda a: a) if dictionary is None else compressor(dictionary).compress
        for batch in batches:
            out = pa.schema([("id", batch.schema.field("id").type), ("row", pa.int64()), ("n_tokens", pa.int64()),
                             ("crc", pa.int64()), ("data", pa.binary())])
            columns, size = [[] for _ in out], 0
            for key, row, text in zip(*(batch.column(c) for c in ("id", "row", "text")), strict=True):
                array = encode(text.as_py() or "") + end
                wide = np.frombuffer(array, encode.width)
                found = key.as_py(), row.as_py(), len(wide), zlib.crc32(wide.astype("<u4").tobytes()), pack(array)
                for column, value in zip(columns, found, strict=True):
                    column.append(value)
                size += len(found[-1])
                if size > TEXT_AT_ONCE << 2:
                    yield record_batch(out, columns)
                    columns, size = [[] for _ in out], 0
            yield record_batch(out, columns)

    return docs.mapInArrow(run, f"id {kind}, row long, n_tokens long, crc long, data binary")


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)


def train(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary for id arrays; empty where there is too little to train on."""
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES)
    sample = short.orderBy(F.xxhash64("id"), "text").limit(SAMPLE_DOCS).select(
        "id", F.lit(0).cast("long").alias("row"), "text")
    arrays = sorted(bytes(r.data) for r in _arrays(sample, path, end_id, None).select("data").collect())
    # The trainer refuses samples that are few or small beside the dictionary.
    size = min(DICTIONARY_BYTES, sum(map(len, arrays)) // 16)
    if len(arrays) < 16 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _file(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def _dictionary_path(folder: str, digest: str) -> str:
    return f"{folder}/{digest}.dictionary"


class _Writer:
    """One archive file."""

    def __init__(self, folder: str, width: int, digest: bytes, part: int, kind: pa.DataType):
        self.path, self.part, self.kind = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}", part, kind
        system, inner = _file(self.path)
        self.out = system.open_output_stream(inner)
        self.out.write(HEAD.pack(MAGIC, width, digest))
        self.at, self.n_tokens = HEAD.size, 0
        self.index = [[], [], [], []]

    def add(self, key: object, n_tokens: int, frame: bytes) -> None:
        self.out.write(frame)
        for column, value in zip(self.index, (key, self.at, len(frame), n_tokens), strict=True):
            column.append(value)
        self.at += len(frame)
        self.n_tokens += n_tokens

    def full(self, file_bytes: int) -> bool:
        return self.at >= file_bytes or len(self.index[0]) >= FILE_DOCS

    def close(self) -> tuple[str, int, int, int, int]:
        schema = pa.schema([("id", self.kind), ("offset", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as stream:
            stream.write_batch(record_batch(schema, self.index))
        index = sink.getvalue()
        self.out.write(index)
        self.out.write(TAIL.pack(self.at, index.size, MAGIC))
        self.out.close()
        return self.path, self.part, self.at + index.size + TAIL.size, len(self.index[0]), self.n_tokens


class Reader:
    """The index of a file, and documents by their places."""

    def __init__(self, path: str):
        system, inner = _file(path)
        self.file, self.path = system.open_input_file(inner), path
        size = self.file.size()
        if size < HEAD.size + TAIL.size:
            raise ValueError(f"{path} is no token archive")
        self.index_at, self.index_size, mark = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        magic, self.width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        if mark != MAGIC or magic != MAGIC or self.index_at + self.index_size + TAIL.size != size:
            raise ValueError(f"{path} is no token archive")
        self.digest = digest.hex()
        dictionary = _dictionary(_dictionary_path(path.rpartition("/")[0], self.digest), self.digest)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared).decompress

    def index(self) -> pa.Table:
        return pa.ipc.open_stream(self.file.read_at(self.index_size, self.index_at)).read_all()

    def ids(self, offset: int, size: int) -> np.ndarray:
        """The ids of one document as unsigned 32-bit integers."""
        return np.frombuffer(self.unpack(self.file.read_at(size, offset)), f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.file.close()


@functools.lru_cache(maxsize=2)
def _dictionary(path: str, digest: str) -> bytes:
    system, inner = _file(path)
    with system.open_input_file(inner) as file:
        data = file.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"{path} does not have its hash")
    return data


def write_archive(
    docs: DataFrame, path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write every document's ids; the catalog (path, size, n_docs, n_tokens, start), a row per file.

    ``path`` is the tokenizer's file; ``start`` is the number of ids in all files before.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    dictionary = train(texts, path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    system, inner = _file(_dictionary_path(folder, digest.hex()))
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(dictionary)
    width = int(encoder(path).width[-1])

    frames = materialize(_arrays(
        texts.withColumn("row", F.monotonically_increasing_id()), path, end_id, dictionary), "frames")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("path", pa.string()), ("part", pa.int32()), ("size", pa.int64()), ("n_docs", pa.int64()),
                         ("n_tokens", pa.int64()), ("seq", pa.int32())])
        writer, seq = None, 0
        for batch in batches:
            kind = batch.schema.field("id").type
            for key, n, frame, part in zip(*(batch.column(c) for c in ("id", "n_tokens", "data", "part")), strict=True):
                if writer is not None and writer.full(file_bytes):
                    yield record_batch(out, [[v] for v in (*writer.close(), seq)])
                    writer, seq = None, seq + 1
                if writer is None:
                    writer = _Writer(folder, width, digest, part.as_py(), kind)
                writer.add(key.as_py(), n.as_py(), frame.as_py())
        if writer is not None:
            yield record_batch(out, [[v] for v in (*writer.close(), seq)])

    order = ["id", "n_tokens", "crc", "row"]
    placed = (frames.repartitionByRange(partitions_of(spark), *order).sortWithinPartitions(*order)
              .select("id", "n_tokens", "data", F.spark_partition_id().alias("part")))
    files = materialize(placed.mapInArrow(
        write, "path string, part int, size long, n_docs long, n_tokens long, seq int"), "files")
    # Sums inside a range, then over the ranges: one row per file and one per range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ranges, "part")
    return materialize(starts.select(
        "path", "size", "n_docs", "n_tokens", (F.col("shift") + F.col("inside")).alias("start")), "catalog")


def list_documents(catalog: DataFrame, id_kind: str = "long") -> DataFrame:
    """(id, path, offset, size, start, n_tokens) of every document, from the files' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = Reader(path)
                index = reader.index().combine_chunks()
                reader.close()
                n = index.column("n_tokens").to_numpy()
                starts = pa.array(start + np.cumsum(n) - n, pa.int64())
                yield from pa.table({
                    "id": index.column("id"), "path": pa.array([path] * len(n), pa.string()),
                    "offset": index.column("offset"), "size": index.column("size"),
                    "start": starts, "n_tokens": index.column("n_tokens")}).to_batches()

    return _spread(catalog).mapInArrow(
        run, f"id {id_kind}, path string, offset long, size long, start long, n_tokens long")


def _spread(catalog: DataFrame) -> DataFrame:
    """The few rows of the catalog dealt to many tasks."""
    return catalog.select("path", "start").repartition(partitions_of(catalog.sparkSession), "path")


def read_documents(listed: DataFrame) -> DataFrame:
    """(id, ids) of some documents, each read by its own byte range."""
    kind = id_type(listed, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            out = pa.schema([("id", batch.schema.field("id").type), ("ids", pa.list_(pa.int64()))])
            for key, path, offset, size in zip(*(batch.column(c) for c in ("id", "path", "offset", "size")), strict=True):
                if reader is None or reader.path != path.as_py():
                    if reader is not None:
                        reader.close()
                    reader = Reader(path.as_py())
                yield record_batch(out, [[key.as_py()], [reader.ids(offset.as_py(), size.as_py()).astype(np.int64)]])

    rows = listed.select("id", "path", "offset", "size").repartition(
        partitions_of(listed.sparkSession), "path").sortWithinPartitions("path", "offset")
    return rows.mapInArrow(run, f"id {kind}, ids array<long>")


def checksums(catalog: DataFrame, id_kind: str = "long") -> DataFrame:
    """(id, start, n_tokens, crc32) of every document, read from the files one frame at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = Reader(path)
                index = reader.index().combine_chunks()
                out = pa.schema([("id", index.schema.field("id").type), ("start", pa.int64()), ("n_tokens", pa.int64()),
                                 ("crc32", pa.int64())])
                for some in index.to_batches(max_chunksize=10_000):
                    columns = [[], [], []]
                    for offset, size, n in zip(*(some.column(c).to_pylist() for c in ("offset", "size", "n_tokens")), strict=True):
                        ids = reader.ids(offset, size)
                        if len(ids) != n:
                            raise ValueError(f"{path} holds {len(ids)} ids where its index says {n}")
                        for column, value in zip(columns, (start, n, zlib.crc32(ids.tobytes())), strict=True):
                            column.append(value)
                        start += n
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id"), *(pa.array(c, pa.int64()) for c in columns)], schema=out)
                reader.close()

    return _spread(catalog).mapInArrow(run, f"id {id_kind}, start long, n_tokens long, crc32 long")
