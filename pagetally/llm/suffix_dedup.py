"""Exact removal of long repeated strings with a logarithmic family of suffix arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts anywhere else too.

**Sampling.** A suffix array of every byte would be many times the size of the texts. Of the
strings of ``HEAD`` bytes inside a window of ``LENGTH`` bytes the one with the smallest
hash is chosen. The choice depends on the window alone, so two equal windows choose the
same head: the suffixes that begin at chosen heads (about one in eighty bytes) are enough to
find every repeated window. Windows that follow one another and choose the same head form
a *run*, which is kept as the range of their first bytes.

**Family.** Texts arrive in batches. A batch's sampled suffixes are put in order of the
hash of their head (equal heads stand together, which is all that matches of ``LENGTH``
bytes need), each head once with the number of its runs. The batch's array is scanned
together with the array of every level, heads that occur twice are noted, and then arrays
of equal size are merged: level n holds 2**n batches. Arrays are tables bucketed by head, so
scans and merges need no shuffle, and no head, however frequent, is more than one row.

**Matches.** Runs of noted heads are read again. Runs with equal bytes are repeated as a
whole. What remains are runs at the edges of repeated passages; the windows of those and of one
run of each kind with the same head are compared as bytes in one task, if there are at most
``SMALL_GROUP`` of them. Runs of a more frequent head are halved and halved again instead (in
``SPLIT`` parts each time, by the distance of the window from its head): a part whose
windows have nothing in common that occurs elsewhere is done, so is a part that occurs
elsewhere as a whole, and only what lies between is split further.

Texts are stored once in compressed form, keyed by a 128-bit hash, so a text with thousands of
copies costs as much as one; copies are repeated as a whole by definition.

Defined results: a null text is empty; a text shorter than ``LENGTH`` bytes loses
nothing; rows that repeat an id are documents of their own; an empty table gives no rows.
Spans are in bytes of the text and may cut a character; ``clean`` drops the cut parts.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.llm.common import id_type, partitions_of, record_batch, slim, utf8_rows
from pagetally.session import discard, scratch, shared_dir
from pagetally.sources.tables import materialize

LENGTH = 200
HEAD = 40
HEADS_IN_WINDOW = LENGTH - HEAD + 1
BATCHES = 4
SMALL_GROUP = 1024
SPLIT = 4
# Long texts are sampled in pieces of so many windows; a place in a piece takes 20 bits.
PIECE = (1 << 20) - LENGTH
PLACES = np.uint64((1 << 20) - 1)
FLUSH_ROWS = 200_000
SEED = 0x5EED

_MASK = (1 << 64) - 1


class Sampler:
    """Chooses heads with a polynomial rolling hash modulo 2**64."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.values = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 8 + 5 & _MASK
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.up) < size:
            size = max(size, 2 * len(self.up))
            inverse = pow(self.base, -1, 1 << 64)
            self.up = np.full(size, self.base, np.uint64)
            self.down = np.full(size, inverse, np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all heads of a piece, and the place of each window's chosen head."""
        size = len(data)
        self._grow(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(self.values[np.frombuffer(data, np.uint8)] * self.up[:size], out=sums[1:])
        hashes = (sums[HEAD:] - sums[:-HEAD]) * self.down[:size - HEAD + 1]
        for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
            hashes ^= hashes >> np.uint64(shift)
            hashes *= np.uint64(factor)
        hashes ^= hashes >> np.uint64(32)
        # The upper bits decide and then the place, so of equal heads the first is chosen.
        # Two equal windows within one run are thus impossible.
        least = hashes & ~PLACES | np.arange(len(hashes), dtype=np.uint64)
        done = 1
        while done < HEADS_IN_WINDOW:
            step = min(done, HEADS_IN_WINDOW - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        return hashes, (least & PLACES).astype(np.int64)

    def runs(self, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Heads and their places, first and last window starts of the runs of a text."""
        for begin in range(0, max(0, len(data) - LENGTH + 1), PIECE):
            hashes, places = self._piece(data[begin:begin + PIECE + LENGTH - 1])
            firsts = np.concatenate(([0], np.flatnonzero(places[1:] != places[:-1]) + 1))
            lasts = np.append(firsts[1:], len(places)) - 1
            own = places[firsts]
            yield hashes[own].view(np.int64), own + begin, firsts + begin, lasts + begin


class Table:
    """A table bucketed and sorted by its keys, in the shared folder.

    Rows that are dealt by the same keys already fill one file per bucket.
    """

    def __init__(self, df: DataFrame, purpose: str, keys: tuple[str, ...]):
        self.spark = df.sparkSession
        self.name = f"{purpose}_{uuid.uuid4().hex}"
        self.path = shared_dir(self.spark, purpose)
        (df.write.bucketBy(partitions_of(self.spark), *keys).sortBy(*keys)
         .option("path", self.path).format("parquet").saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)


class Family:
    """Levels of sampled suffix arrays; level n holds the heads of 2**n batches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: dict[int, Table] = {}
        self.noted: list[DataFrame] = []

    def add(self, heads: DataFrame) -> None:
        """Take in a batch, given as one ``head`` per run."""
        counted = heads.groupBy("head").agg(F.count("*").alias("n"))
        new = Table(counted, "suffixes", ("head",))
        repeated = new.read().where("n > 1").select("head")
        for level in self.levels.values():
            older = level.read().select("head")
            repeated = repeated.union(new.read().select("head").join(older, "head"))
        self.noted.append(materialize(repeated, "noted"))
        level = 0
        while level in self.levels:
            other = self.levels.pop(level)
            a, b = new.read(), other.read().withColumnRenamed("n", "m")
            both = a.join(b, "head", "full").select(
                "head", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
            merged = Table(both, "suffixes", ("head",))
            new.drop()
            other.drop()
            new, level = merged, level + 1
        self.levels[level] = new

    def repeated_heads(self) -> DataFrame:
        """Heads that more than one run has, over all batches so far."""
        out = self.noted[0]
        for more in self.noted[1:]:
            out = out.union(more)
        return out.distinct()

    def drop(self) -> None:
        for level in self.levels.values():
            level.drop()
        self.levels = {}


def _text_key(data: bytes) -> tuple[int, int]:
    digest = hashlib.sha256(data).digest()
    return (int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id) per row."""
    schema = f"k1 long, k2 long, id {id_type(docs, id_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_text_key(text or b"") for _, text in utf8_rows(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 batch.column("id")], ["k1", "k2", "id"])

    return slim(docs, id_col, text_col).mapInArrow(run, schema)


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, n_bytes, packed) per row."""

    out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = []
            for _, text in utf8_rows(batch):
                data = text or b""
                rows.append((*_text_key(data), len(data), pack(data)))
            if rows:
                yield record_batch(out, [list(c) for c in zip(*rows, strict=True)])

    return slim(docs, id_col, text_col).mapInArrow(run, "k1 long, k2 long, n_bytes long, packed binary")


def _rows_out(schema: pa.Schema, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


def _heads(store: DataFrame) -> DataFrame:
    """The head of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, unpack = Sampler(), zstandard.ZstdDecompressor().decompress
        schema, held, size = pa.schema([("head", pa.int64())]), [], 0
        for batch in batches:
            for packed in batch.column("packed"):
                for heads, _, _, _ in sampler.runs(unpack(packed.as_py())):
                    held.append((heads,))
                    size += len(heads)
                if size > FLUSH_ROWS:
                    yield _rows_out(schema, held)
                    held, size = [], 0
        if held:
            yield _rows_out(schema, held)

    return store.select("packed").mapInArrow(run, "head long")


def _runs(store: DataFrame) -> DataFrame:
    """(head, k1, k2, place, first, last, same) of every run; ``same`` hashes its bytes."""
    fields = [(c, pa.int64()) for c in ("head", "k1", "k2", "place", "first", "last", "same")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, unpack = Sampler(), zstandard.ZstdDecompressor().decompress
        schema, held, size, digest = pa.schema(fields), [], 0, xxhash.xxh3_64_digest
        for batch in batches:
            for k1, k2, packed in zip(*(batch.column(c) for c in ("k1", "k2", "packed")), strict=True):
                data = unpack(packed.as_py())
                for heads, places, firsts, lasts in sampler.runs(data):
                    spans = zip(firsts.tolist(), (lasts + LENGTH).tolist(), strict=True)
                    same = np.frombuffer(b"".join([digest(data[a:b], SEED) for a, b in spans]), np.int64)
                    own = np.ones(len(heads), np.int64)
                    held.append((heads, own * k1.as_py(), own * k2.as_py(), places, firsts, lasts, same))
                    size += len(heads)
                if size > FLUSH_ROWS:
                    yield _rows_out(schema, held)
                    held, size = [], 0
        if held:
            yield _rows_out(schema, held)

    return store.select("k1", "k2", "packed").mapInArrow(
        run, "head long, k1 long, k2 long, place long, first long, last long, same long")


def _edges(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted runs: (head, k1, k2, place, first, last, size, bytes)."""
    lists = wanted.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("head", "place", "first", "last", "size")).alias("runs"))
    joined = store.select("k1", "k2", "packed").join(lists, ["k1", "k2"])
    schema = "head long, k1 long, k2 long, place long, first long, last long, size long, bytes binary"
    out = pa.schema([*[(c, pa.int64()) for c in ("head", "k1", "k2", "place", "first", "last", "size")],
                     ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        rows = []
        for batch in batches:
            for k1, k2, packed, runs in zip(
                    *(batch.column(c) for c in ("k1", "k2", "packed", "runs")), strict=True):
                data, k1, k2 = unpack(packed.as_py()), k1.as_py(), k2.as_py()
                for r in runs.as_py():
                    rows.append((r["head"], k1, k2, r["place"], r["first"], r["last"], r["size"],
                                 data[r["first"]:r["last"] + LENGTH]))
                if len(rows) > 10_000:
                    yield record_batch(out, [list(c) for c in zip(*rows, strict=True)])
                    rows = []
        if rows:
            yield record_batch(out, [list(c) for c in zip(*rows, strict=True)])

    return joined.select("k1", "k2", "packed", "runs").mapInArrow(run, schema)


def _ranges(places: list[int]) -> Iterator[tuple[int, int]]:
    start = last = places[0]
    for p in places[1:]:
        if p != last + 1:
            yield start, last
            start = p
        last = p
    yield start, last


def _compare_small(edges: DataFrame) -> DataFrame:
    """Repeated windows among runs of one head, compared as bytes: (k1, k2, first, last)."""
    dealt = edges.repartition(partitions_of(edges.sparkSession), "head").sortWithinPartitions("head")
    out = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "first", "last")])

    def found(group: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
        seen: dict[bytes, int] = {}
        for _, _, _, data in group:
            for i in range(len(data) - LENGTH + 1):
                window = data[i:i + LENGTH]
                seen[window] = seen.get(window, 0) + 1
        for k1, k2, first, data in group:
            places = [first + i for i in range(len(data) - LENGTH + 1) if seen[data[i:i + LENGTH]] > 1]
            if places:
                for a, b in _ranges(places):
                    yield k1, k2, a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, group, rows = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("head", "k1", "k2", "first", "bytes")]
            for own, *rest in zip(*columns, strict=True):
                if own != head:
                    rows += found(group)
                    head, group = own, []
                    if len(rows) > FLUSH_ROWS:
                        yield record_batch(out, [list(c) for c in zip(*rows, strict=True)])
                        rows = []
                group.append(rest)
        rows += found(group)
        if rows:
            yield record_batch(out, [list(c) for c in zip(*rows, strict=True)])

    return dealt.select("head", "k1", "k2", "first", "bytes").mapInArrow(
        run, "k1 long, k2 long, first long, last long")


def _parts(runs: DataFrame, width: int) -> DataFrame:
    """Runs cut into parts of windows whose distance from the head lies in one ``width``.

    ``core`` hashes the bytes that all windows of such a width have in common, ``same`` the
    bytes and distances of the part. Two equal windows lie in parts of the same core.
    """
    names = ("head", "core", "same", "k1", "k2", "place", "first", "last")
    out = pa.schema([*[(c, pa.int64()) for c in names], ("bytes", pa.binary())])

    def signed(digest: bytes) -> int:
        return int.from_bytes(digest, "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_digest
        for batch in batches:
            rows = []
            for head, k1, k2, place, first, last, data in zip(*(
                    batch.column(c).to_pylist() for c in ("head", "k1", "k2", "place", "first", "last", "bytes")),
                    strict=True):
                for part in range((place - last) // width, (place - first) // width + 1):
                    near, far = part * width, part * width + width - 1
                    a, b = max(first, place - far), min(last, place - near)
                    core = data[place - near - first:place - far + LENGTH - first]
                    own = data[a - first:b + LENGTH - first]
                    rows.append((head, signed(digest(core, part)),
                                 signed(digest(own, (place - a) * LENGTH + place - b)), k1, k2, place, a, b, own))
            yield record_batch(out, [list(c) for c in zip(*rows, strict=True)] or [[] for _ in out])

    return runs.select("head", "k1", "k2", "place", "first", "last", "bytes").mapInArrow(
        run, "head long, core long, same long, k1 long, k2 long, place long, first long, last long, bytes binary")


def _compare_large(edges: DataFrame) -> DataFrame:
    """The same for heads of any number of runs, by splitting runs further and further."""
    keys, found, width = ["head", "core", "same"], None, HEADS_IN_WINDOW
    while width > 1 and not edges.isEmpty():
        width = -(-width // SPLIT)
        parts = materialize(_parts(edges, width), "parts")
        one = F.struct("k1", "k2", "place", "first", "last", "bytes")
        kinds = materialize(parts.groupBy(*keys).agg(F.count("*").alias("n"), F.first(one).alias("one")), "kinds")
        whole = parts.join(kinds.where("n > 1").select(*keys), keys, "left_semi").select("k1", "k2", "first", "last")
        found = whole if found is None else found.union(whole)
        sizes = materialize(kinds.groupBy("head", "core").agg(
            F.count("*").alias("size"), F.min("n").alias("fewest")).where("fewest = 1 AND size > 1"), "sizes")
        edges = kinds.join(sizes.select("head", "core"), ["head", "core"]).select("head", "one.*")
    empty = edges.select("k1", "k2", "first", "last").limit(0)
    return empty if found is None else found


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES,
) -> tuple[DataFrame, DataFrame]:
    """Documents as (id, k1, k2), and texts as (k1, k2, n_bytes, spans, kept, ...).

    A text has the key of its documents; ``spans`` are its removed runs of bytes in order
    and ``kept`` is what is left, compressed with zstd.
    """
    spark = docs.sparkSession
    ids = materialize(_keyed(docs, id_col, text_col), "ids")
    # Folders and catalog entries made on the way go at the end, after a failure too.
    with scratch(spark) as outside, contextlib.ExitStack() as ends:
        texts = _packed(docs, id_col, text_col).groupBy("k1", "k2").agg(
            F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("packed").alias("packed"))
        store = Table(texts, "texts", ("k1", "k2"))
        ends.callback(store.drop)

        family = Family(spark)
        ends.callback(family.drop)
        for b in range(batches):
            family.add(_heads(store.read().where(F.pmod("k2", F.lit(batches)) == b)))
        noted = materialize(family.repeated_heads(), "repeated")
        family.drop()

        runs = materialize(_runs(store.read()).join(noted, "head"), "runs")
        kinds = materialize(
            runs.groupBy("head", "same").agg(
                F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place", "first", "last")).alias("one")), "kinds")
        sizes = materialize(kinds.groupBy("head").agg(
            F.count("*").alias("size"), F.min("n").alias("fewest")).where("fewest = 1 AND size > 1"), "sizes")
        wanted = kinds.join(sizes, "head").select("head", "size", "one.*")
        edges = materialize(_edges(store.read(), wanted), "edges")
        parts = _compare_small(edges.where(F.col("size") <= SMALL_GROUP)).union(
            _compare_large(edges.where(F.col("size") > SMALL_GROUP)))
        whole = runs.join(kinds.where("n > 1").select("head", "same"), ["head", "same"], "left_semi").select(
            "k1", "k2", "first", "last")
        # A run stands for its kind only if it is the single one, so each window found here is its own.
        starts = whole.union(parts).groupBy("k1", "k2").agg(
            F.collect_list(F.struct("first", "last")).alias("starts"))
        with outside():
            cut = materialize(_cut(store.read().join(starts, ["k1", "k2"], "left")), "cut")
    return ids, cut


def _cut(texts: DataFrame) -> DataFrame:
    schema = ("k1 long, k2 long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, "
              "kept binary, kept_sha256 string")
    out = pa.schema([
        ("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows, size = [], 0
            for k1, k2, copies, n_bytes, packed, starts in zip(*(batch.column(c) for c in (
                    "k1", "k2", "copies", "n_bytes", "packed", "starts")), strict=True):
                whole, n = packed.as_py(), n_bytes.as_py()
                data = unpack(whole)
                spans: list[list[int]] = []
                if copies.as_py() > 1 and n >= LENGTH:
                    spans = [[0, n]]
                else:
                    for s in sorted((s["first"], s["last"]) for s in starts.as_py() or ()):
                        if spans and s[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], s[1] + LENGTH)
                        else:
                            spans.append([s[0], s[1] + LENGTH])
                if spans:
                    ends = [0, *(b for _, b in spans)]
                    data = b"".join([data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), n], strict=True)])
                    whole = pack(data)
                rows.append((k1.as_py(), k2.as_py(), n, n - len(data),
                             [{"start": a, "end": b} for a, b in spans], whole,
                             hashlib.sha256(data).hexdigest()))
                size += len(whole)
                if size > 4 << 20:
                    yield record_batch(out, [list(c) for c in zip(*rows, strict=True)])
                    rows, size = [], 0
            if rows:
                yield record_batch(out, [list(c) for c in zip(*rows, strict=True)])

    return texts.select("k1", "k2", "copies", "n_bytes", "packed", "starts").mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES,
) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) per row of ``docs``."""
    ids, cut = repeated_spans(docs, id_col, text_col, batches)
    return ids.join(cut.drop("kept"), ["k1", "k2"]).select(
        F.col("id").alias(id_col), "n_bytes", "n_removed", "spans", "kept_sha256")


def clean(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES,
) -> DataFrame:
    """``docs`` with repeated strings cut out of the texts; other columns stay.

    A null text stays null. Where a span ends inside a character, what is left of it is
    dropped, so the text is valid.
    """
    _, cut = repeated_spans(docs, id_col, text_col, batches)
    others = [c for c in docs.columns if c != text_col]
    free = "_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    null, k1, k2, left, text = (free + c for c in ("null", "k1", "k2", "kept", "text"))
    small = docs.select(
        *others, docs[text_col].isNull().alias(null),
        *[F.conv(F.substring(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256), at, 16), 16, -10).cast("long")
          .alias(name) for at, name in ((1, k1), (17, k2))])
    joined = small.join(cut.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("kept").alias(left)),
                        [k1, k2]).select(*others, null, left)
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField(text, T.StringType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in rows:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if n.as_py() else unpack(p.as_py()).decode("utf-8", "ignore")
                         for n, p in zip(part.column(null), part.column(left), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in others] + [pa.array(texts, pa.string())], [*others, text])

    return joined.mapInArrow(run, schema).withColumnRenamed(text, text_col).select(*docs.columns)
