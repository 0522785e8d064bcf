"""Phrases whose words stand together more often than apart, from FM-indexes of text shards.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and into words at
spaces and tabs. A shard is about ``SHARD_WORDS`` words of one group, as numbers of its own
word list, with a mark after each piece; a shard ends with a piece, so no phrase lies in two.

Each shard gets an index of its words in both directions: the Burrows-Wheeler transform of the
numbers and that of the reversed numbers, both ordered by ``DEPTH`` words, which is as
far as phrases go. A phrase is a pair of intervals, one in each order. Extending it by a word on the
left counts that word's places in the first transform, on the right in the second; the other
interval moves by the number of smaller words, so both stay in step. Extensions of
all phrases of a shard are found at once with numpy.

Phrases grow by one word a round. A longer phrase is looked at only where it is reached from both
sides: as a right extension of its first words and as a left extension of its last ones, both
of which were frequent; as all parts of a frequent phrase are frequent, none is lost. Nearly all
that a shard finds is rare even so, so a shard sends hashes with counts, packed by ranges
of the hash. The counts of a range are summed over all shards of the group, and each shard is told
by a bit per phrase whether its sum reaches ``min_count``. The first shard that has a phrase
is told the sum too and gives its text. Phrases of a group are taken for the same if all 96 bits of
two independent hashes agree; among 10^12 different ones a clash has a chance below 10^-5.

Shards and indexes are files in the shared folder, written and read by tasks through pyarrow's file
systems; tables hold their paths, bits and intervals. A repeated task writes a new file.

A phrase is scored at its weakest cut into two parts, l and r being how often these occur, as
floor(2000000 a / (l + r)) in decimals, and dropped if it lies in a longer frequent phrase with at
least 0.8 of its count. The phrase one word longer is then frequent enough too, so
comparing with left and right extensions by one word is enough.

Defined results: a null text is empty; a null group is ``und`` and joins rows that say so; rows
count as often as they are repeated; ties of the score go to the higher count, then to the
smaller phrase by UTF-8 bytes; an empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetally.llm.common import partitions_of, record_batch, utf8_rows
from pagetally.session import discard, shared_dir
from pagetally.sources.tables import materialize

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
CONTAINED_PERCENT = 80
SHARD_WORDS = 1 << 20
# Ranges of the hash are made for so many words of the largest group each.
RANGE_WORDS = 4 << 20
# An odd number whose bits are spread well, to mix hashes of words.
MIX = np.uint64(0x9E3779B97F4A7C15)
# Unfinished shards of all groups in a task hold at most so many words.
HELD_WORDS = 3 << 20
MARK = b"."
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", MARK * 10 + b" ")
# Bytes that split() takes for white space are in PIECES; others stay inside words.


class _Shard:
    """Words of one group, numbered from 1 as they come; 0 ends a piece."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.numbers[MARK] = 0
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def finish(self) -> tuple[list[bytes], list[int], np.ndarray]:
        ids = np.concatenate(self.parts)
        del self.numbers[MARK]
        # Numbers may have been given out in gaps by the mark's entry.
        words = list(self.numbers)
        renumbered = np.zeros(max(self.numbers.values(), default=0) + 1, np.int32)
        renumbered[list(self.numbers.values())] = np.arange(1, len(words) + 1)
        ids = renumbered[ids]
        counts = np.bincount(ids, minlength=len(words) + 1)[1:].tolist()
        return words, counts, ids


def _pieces(words: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """A text's words in parts that end with a piece and hold about so many words."""
    at = 0
    while len(words) - at > limit:
        try:
            end = words.index(MARK, at + limit) + 1
        except ValueError:
            break
        yield words[at:end]
        at = end
    if at < len(words):
        yield words[at:]


def _store(folder: str, table: pa.Table) -> str:
    """Write one row of arrays to a new file; its path."""
    path = f"{folder}/{uuid.uuid4().hex}"
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    with system.open_output_stream(inner) as out, pa.ipc.new_stream(
            out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return path


def _load(path: str) -> pa.Table:
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    with system.open_input_stream(inner) as file:
        return pa.ipc.open_stream(file).read_all().combine_chunks()


def _one(values: pa.Array) -> pa.ListArray:
    """An array as the only row of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _array(table: pa.Table, name: str) -> pa.Array:
    return table.column(name)[0].values


def _folder(spark: SparkSession, purpose: str) -> str:
    folder = shared_dir(spark, purpose)
    system, inner = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    return folder


def shards(docs: DataFrame, folder: str, group_col: str, text_col: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, grp, words, counts, path): word lists with counts, and the numbered text in a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("shard", pa.int64()), ("grp", pa.string()), ("words", pa.list_(pa.string())),
                         ("counts", pa.list_(pa.int64())), ("path", pa.string())])
        number = itertools.count(TaskContext.get().partitionId() << 32)
        held: dict[str, _Shard] = {}

        def close(group: str) -> pa.RecordBatch:
            words, counts, ids = held.pop(group).finish()
            words = pa.array(words, pa.binary()).cast(pa.string())
            path = _store(folder, pa.table({"words": _one(words), "ids": _one(pa.array(ids))}))
            return pa.RecordBatch.from_arrays(
                [pa.array([next(number)]), pa.array([group]), _one(words), _one(pa.array(counts, pa.int64())),
                 pa.array([path])], schema=out)

        for batch in batches:
            for group, text in utf8_rows(batch):
                # Also splits at the other white space that is a piece's end by now.
                words = (text or b"").lower().translate(PIECES).replace(MARK, b" . ").split()
                if not words:
                    continue
                if words[-1] != MARK:
                    words.append(MARK)
                for part in _pieces(words, shard_words):
                    shard = held.setdefault(group, None) or _Shard()
                    held[group] = shard
                    shard.add(part)
                    if shard.size >= shard_words:
                        yield close(group)
                if sum(s.size for s in held.values()) > max(HELD_WORDS, shard_words):
                    yield close(max(held, key=lambda g: held[g].size))
        for group in list(held):
            yield close(group)

    rows = docs.select(
        F.coalesce(docs[group_col].cast("string"), F.lit("und")).alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "shard long, grp string, words array<string>, counts array<long>, path string")


def transform(text: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of a circular text, its rotations ordered by DEPTH symbols."""
    width = int(text.max(initial=0)) + 1
    pairs = text.astype(np.int64) * width + np.roll(text, -1)
    if width >= 1 << 15:
        _, pairs = np.unique(pairs, return_inverse=True)
    key = pairs * (int(pairs.max(initial=0)) + 1) + np.roll(pairs, -2)
    return text[np.argsort(key, kind="stable") - 1]


class FmIndex:
    """Ranks in a transform: where the places of each symbol lie, in order."""

    def __init__(self, bwt: np.ndarray):
        self.bwt, self.n = bwt, len(bwt)
        # The row after each row's rotation by one symbol, by (symbol, row).
        self.next = np.argsort(bwt, kind="stable")
        self.places = bwt[self.next].astype(np.int64) * self.n + self.next
        self.first = np.searchsorted(bwt[self.next], np.arange(int(bwt.max(initial=0)) + 2))

    def step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The row that a symbol before a row leads to: smaller symbols and equal ones above."""
        return np.searchsorted(self.places, symbols.astype(np.int64) * self.n + rows)

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        """The first symbol of each row."""
        return np.searchsorted(self.first, rows, side="right") - 1


@dataclass
class Phrases:
    """Intervals of phrases of one length: start in either order, and size."""

    low: np.ndarray
    reverse_low: np.ndarray
    size: np.ndarray

    def of(self, chosen: np.ndarray) -> Phrases:
        return Phrases(self.low[chosen], self.reverse_low[chosen], self.size[chosen])


class BothWays:
    """A text's index in both directions."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray):
        self.forward, self.backward = FmIndex(forward), FmIndex(backward)

    def words(self) -> Phrases:
        """The phrases of one word: every symbol but the mark, at the same place in both orders."""
        first = self.forward.first
        return Phrases(first[1:-1], first[1:-1], np.diff(first)[1:])

    @staticmethod
    def _extend(index: FmIndex, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> Phrases:
        """All extensions on the side of an index; ``other`` are the starts in the other order."""
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        width = int(index.bwt.max(initial=0)) + 1
        found, counts = np.unique(owner * width + index.bwt[rows], return_counts=True)
        owner, symbol = found // width, found % width
        # Extensions by smaller symbols, the mark too, lie before in the other order.
        smaller = np.cumsum(counts) - counts
        start = np.searchsorted(owner, np.arange(len(low)))
        moved = other[owner] + smaller - smaller[start][owner]
        words = symbol > 0
        owner, symbol = owner[words], symbol[words]
        return Phrases(index.step(symbol, low[owner]), moved[words], counts[words])

    def left(self, phrases: Phrases) -> Phrases:
        return self._extend(self.forward, phrases.low, phrases.reverse_low, phrases.size)

    def right(self, phrases: Phrases) -> Phrases:
        found = self._extend(self.backward, phrases.reverse_low, phrases.low, phrases.size)
        return Phrases(found.reverse_low, found.low, found.size)

    def longer(self, phrases: Phrases) -> Phrases:
        """Phrases one word longer whose first words and whose last words are both given."""
        if not len(phrases.low):
            return phrases
        right, left = self.right(phrases), self.left(phrases)
        return right.of(np.isin(right.low, left.low))

    def symbols(self, phrases: Phrases, length: int) -> list[np.ndarray]:
        """The words of each phrase, by place."""
        out, rows = [], phrases.low
        for _ in range(length):
            out.append(self.forward.symbol(rows))
            rows = self.forward.next[rows]
        return out


def pruned(ids: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The numbered text with words not kept turned into marks, one mark between pieces at most.

    ``kept`` ascends; its words are numbered anew from 1. The last symbol is a mark.
    """
    anew = np.zeros(max(int(ids.max(initial=0)), int(kept.max(initial=0))) + 1, np.int32)
    anew[kept] = np.arange(1, len(kept) + 1)
    text = anew[ids]
    text = text[(text > 0) | (np.concatenate(([0], text[:-1])) > 0)]
    return np.append(text, np.int32(0)) if not len(text) or text[-1] else text


def _indexed(found: DataFrame) -> DataFrame:
    """(shard, grp, path, n) of the indexes of shards, from the numbers of the words to keep."""
    folder = _folder(found.sparkSession, "indexes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("shard", pa.int64()), ("grp", pa.string()), ("path", pa.string()), ("n", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                kept = np.sort(batch.column("kept")[i].values.to_numpy(zero_copy_only=False))
                source = _load(batch.column("path")[i].as_py())
                text = pruned(_array(source, "ids").to_numpy(), kept)
                words = _array(source, "words").take(pa.array(kept - 1))
                digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.to_pylist())), np.uint64)
                path = _store(folder, pa.table({
                    "words": _one(words), "hashes": _one(pa.array(digests[::2])), "checks": _one(pa.array(digests[1::2])),
                    "forward": _one(pa.array(transform(text))), "backward": _one(pa.array(transform(text[::-1])))}))
                yield record_batch(out, [
                    [batch.column("shard")[i].as_py()], [batch.column("grp")[i].as_py()], [path], [len(text)]])

    return found.select("shard", "grp", "path", "kept").mapInArrow(
        run, "shard long, grp string, path string, n long")


class _Round:
    """One shard in one round: its phrases of a length, in the order of their hashes."""

    def __init__(self, path: str, shorter: pa.StructScalar | None, length: int):
        source = _load(path)
        both = BothWays(*(_array(source, c).to_numpy() for c in ("forward", "backward")))
        known = both.words()
        if shorter is not None:
            known = Phrases(*(shorter[c].values.to_numpy() for c in ("low", "reverse_low", "size")))
        found = both.longer(known)
        symbols = both.symbols(found, length)
        mixed = []
        for name in ("hashes", "checks"):
            of, value = _array(source, name).to_numpy(), np.zeros(len(found.low), np.uint64)
            for word in symbols:
                value = (value ^ of[word - 1]) * MIX
                value ^= value >> np.uint64(29)
            mixed.append(value)
        order = np.argsort(mixed[0], kind="stable")
        self.hashes, self.checks, self.found = mixed[0][order], mixed[1][order], found.of(order)
        self.symbols, self.words = [s[order] for s in symbols], _array(source, "words")

    def ranges(self, n: int) -> np.ndarray:
        """Where each of n equal ranges of the hash begins, and the end."""
        borders = np.array([(i << 64) // n for i in range(n)], np.uint64)
        return np.append(np.searchsorted(self.hashes, borders), len(self.hashes))


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpacked(data: list[bytes], kind: type) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(d), kind) for d in data]


def _sums(given: DataFrame, length: int, ranges: int, min_count: int) -> DataFrame:
    """(shard, part, bits, owned, sums) for the phrases of a shard in a range of the hash.

    A bit for each that is frequent, one for each that the shard gives the text of, and the latter's counts
    in the whole group.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("grp", pa.string()), ("part", pa.int32()), ("shard", pa.int64()),
                         *((c, pa.binary()) for c in ("hashes", "checks", "counts"))])
        for batch in batches:
            for i in range(batch.num_rows):
                shard, grp, path = (batch.column(c)[i].as_py() for c in ("shard", "grp", "path"))
                own = _Round(path, batch.column("shorter")[i] if length > 2 else None, length)
                at = own.ranges(ranges)
                for part in range(ranges):
                    a, b = at[part:part + 2]
                    if a < b:
                        # The first hash, then differences, whose high bytes are zero.
                        steps = np.diff(own.hashes[a:b], prepend=np.uint64(0))
                        checks = (own.checks[a:b] >> np.uint64(32)).astype(np.uint32)
                        yield record_batch(out, [[grp], [part], [shard], [_packed(steps)], [_packed(checks)],
                                                 [_packed(own.found.size[a:b].astype(np.int64))]])

    def add(table: pa.Table) -> pa.Table:
        """All shards of a group in one range."""
        steps, checks, counts = (_unpacked(table.column(c).to_pylist(), kind) for c, kind in (
            ("hashes", np.uint64), ("checks", np.uint32), ("counts", np.int64)))
        ends = np.cumsum([len(c) for c in counts])[:-1]
        hashes = np.concatenate([np.cumsum(s, dtype=np.uint64) for s in steps])
        checks, counts = np.concatenate(checks), np.concatenate(counts)
        order = np.lexsort((checks, hashes))
        new = np.concatenate(([True], (np.diff(hashes[order]) > 0) | (checks[order][1:] != checks[order][:-1])))
        sums = np.empty(len(order), np.int64)
        sums[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        owned = np.empty(len(order), bool)
        owned[order] = new
        owned &= sums >= min_count
        told = [(np.packbits(t >= min_count).tobytes(), np.packbits(o).tobytes(), t[o].tobytes())
                for t, o in zip(np.split(sums, ends), np.split(owned, ends), strict=True)]
        return pa.table({"shard": table.column("shard"), "part": table.column("part"), **{
            name: pa.array(list(values), pa.binary())
            for name, values in zip(("bits", "owned", "sums"), zip(*told, strict=True), strict=True)}})

    columns = ["shard", "grp", "path", *(["shorter"] if length > 2 else [])]
    sent = given.select(*columns).mapInArrow(
        send, "grp string, part int, shard long, hashes binary, checks binary, counts binary")
    return sent.groupBy("grp", "part").applyInArrow(
        add, "shard long, part int, bits binary, owned binary, sums binary")


def _counted(given: DataFrame, length: int, ranges: int) -> DataFrame:
    """(shard, grp, path, phrases, counts, shorter) of shards that were ``told`` their frequent phrases.

    Phrases are those that the shard owns, with counts in the whole group; ``shorter`` holds the intervals of all, from which the next round goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        out = pa.schema([("shard", pa.int64()), ("grp", pa.string()), ("path", pa.string()),
                         ("phrases", pa.list_(pa.string())), ("counts", longs),
                         ("shorter", pa.struct([("low", longs), ("reverse_low", longs), ("size", longs)]))])
        for batch in batches:
            for i in range(batch.num_rows):
                shard, grp, path = (batch.column(c)[i].as_py() for c in ("shard", "grp", "path"))
                own = _Round(path, batch.column("shorter")[i] if length > 2 else None, length)
                at, chosen = own.ranges(ranges), np.zeros(len(own.hashes), bool)
                sums = np.zeros(len(own.hashes), np.int64)
                for told in batch.column("told")[i].as_py():
                    a, b = at[told["part"]:told["part"] + 2]
                    bits, owned = (np.unpackbits(np.frombuffer(told[c], np.uint8), count=b - a).astype(bool)
                                   for c in ("bits", "owned"))
                    chosen[a:b] = bits
                    sums[a:b][owned] = np.frombuffer(told["sums"], np.int64)
                owned = sums > 0
                phrases = pc.binary_join_element_wise(
                    *(own.words.take(pa.array(s[owned] - 1)) for s in own.symbols), " ")
                found = own.found.of(chosen)
                found = found.of(np.argsort(found.low))
                low, back, size = (_one(pa.array(v.astype(np.int64))) for v in (found.low, found.reverse_low, found.size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([grp]), pa.array([path]), _one(phrases), _one(pa.array(sums[owned])),
                     pa.StructArray.from_arrays([low, back, size], ["low", "reverse_low", "size"])], schema=out)

    columns = ["shard", "grp", "path", "told", *(["shorter"] if length > 2 else [])]
    return given.select(*columns).mapInArrow(
        run, "shard long, grp string, path string, phrases array<string>, counts array<long>, "
             "shorter struct<low: array<long>, reverse_low: array<long>, size: array<long>>")


def _listed(shards: DataFrame, phrases: str) -> DataFrame:
    """(grp, phrase, f) from lists with counts."""
    return shards.select("grp", F.explode(F.arrays_zip(F.col(phrases).alias("phrase"), F.col("counts").alias("f"))).alias(
        "p")).select("grp", "p.*")


def frequent_phrases(
    docs: DataFrame, group_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT,
    shard_words: int = SHARD_WORDS, range_words: int = RANGE_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to DEPTH words with their counts, (grp, phrase, f, len), and words per group, (grp, n)."""
    spark = docs.sparkSession
    folder = _folder(spark, "texts")
    texts = materialize(shards(docs, folder, group_col, text_col, shard_words), "shards")
    words = texts.select("shard", "grp", F.posexplode("words").alias("at", "phrase"))
    sizes = materialize(texts.select(
        "grp", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("grp").agg(
        F.sum("n").alias("n")), "sizes")
    single = _listed(texts, "words").groupBy("grp", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    frequent = [materialize(single.withColumn("len", F.lit(1)), "frequent")]
    kept = words.join(frequent[0], ["grp", "phrase"]).groupBy("shard").agg(
        # At most the words of one shard.
        F.collect_list((F.col("at") + 1).cast("long")).alias("kept"))
    found = materialize(texts.select("shard", "grp", "path").join(kept, "shard"), "kept")
    given = materialize(_indexed(_spread(found)), "indexes")
    discard(spark, folder)
    # Ranges of the hash, so that a range of the largest group holds about so many phrases.
    largest = given.groupBy("grp").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first().n
    ranges = max(1, -(-(largest or 0) // range_words))
    for length in range(2, DEPTH + 1):
        told = materialize(_sums(_spread(given), length, ranges, min_count).groupBy("shard").agg(
            F.collect_list(F.struct("part", "bits", "owned", "sums")).alias("told")), "told")
        given = materialize(_counted(_spread(given.join(told, "shard")), length, ranges), "counted")
        frequent.append(_listed(given, "phrases").withColumn("len", F.lit(length)))
    return functools.reduce(DataFrame.unionByName, frequent), sizes


def _spread(rows: DataFrame) -> DataFrame:
    """Rows that stand for a file each, dealt to many tasks."""
    return rows.repartition(partitions_of(rows.sparkSession), "shard")


def _score(a: str, left: str, right: str):
    return F.expr(f"(CAST({SCALE} AS DECIMAL(8,0)) * CAST({a} AS DECIMAL(20,0))) "
                  f"div (CAST({left} AS DECIMAL(20,0)) + CAST({right} AS DECIMAL(20,0)))")


def collocations(
    docs: DataFrame, group_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP,
    contained_percent: int = CONTAINED_PERCENT, shard_words: int = SHARD_WORDS, range_words: int = RANGE_WORDS,
) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each group."""
    phrases, sizes = frequent_phrases(docs, group_col, text_col, min_count, shard_words, range_words)
    phrases = materialize(phrases, "phrases")
    several = phrases.where("len > 1").withColumnRenamed("f", "a")

    cuts = several.select("*", F.explode(F.expr("sequence(1, len - 1)")).alias("k")).select(
        "grp", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - len)").alias("rest"))
    of = lambda name, count: phrases.select("grp", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(of("first", "l"), ["grp", "first"]).join(of("rest", "r"), ["grp", "rest"])
    scored = cuts.withColumn("score", _score("a", "l", "r")).groupBy("grp", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # The phrases of one word less in a phrase, at its left and right end.
    inner = several.where("len > 2").select("grp", "a", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', len - 1)"), F.expr("substring_index(phrase, ' ', 1 - len)"))).alias("phrase"))
    longer = inner.groupBy("grp", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
    free = scored.join(longer, ["grp", "phrase"], "left").where(
        F.col("longer").isNull() | (wide("longer", 100) < wide("a", contained_percent)))

    best = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = free.select("grp", "phrase", "a", "cut.score", "cut.l", "cut.r")
    ranked = flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(sizes, "grp").select(
        "grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
