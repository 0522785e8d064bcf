"""SentencePiece encoding with byte spans of the original text, and decoding.

Normalisation walks the model's compiled character map: at each place the longest known
prefix is replaced, anything else is copied, and every normalised byte remembers the
original byte it came from. Pieces are cut from the normalised text, so each piece's ends
project back to a span of the original bytes. Spans of a text follow one another without
gaps, except where normalisation drops leading or trailing spaces.

Merges never cross a place before a space mark, nor a newline that no piece holds, so a
text is merged chunk by chunk and the pieces of frequent chunks are remembered. The merges
of a chunk that is not remembered are the sentencepiece library's own. A vocabulary with pieces
that hold a space mark elsewhere is merged text by text.

Defined results: a null text is read as empty; an empty text has only the end id; repeated
ids are encoded row by row; an empty table gives no rows. The model file is read by the
driver and sent once to each executor (its size is checked).
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb

from pagetally.llm.common import utf8_rows

SPACE_MARK = "▁"
MARK = SPACE_MARK.encode()
REPLACEMENT = "�".encode()
MAX_MODEL_BYTES = 64 << 20
REMEMBERED_CHUNKS = 1 << 18
REMEMBERED_LENGTH = 64
BATCH_BYTES = 2 << 20

# Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """Longest-prefix replacement by a compiled double-array trie.

    The blob holds the trie's size in bytes, its 32-bit units and then the replacements,
    each ended by a zero byte. A unit's lowest byte is its label, bit 8 says that it
    has a value and the rest is the offset to its children.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.replacements = blob[4 + size:]

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019  one map per process
    def _short(self, window: bytes) -> tuple[int, bytes]:
        units, best, value = self.units, 0, 0
        at = self._children(units[0])
        for length, byte in enumerate(window, 1):
            at ^= byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                break
            unit = units[at]
            at ^= self._children(unit)
            if unit >> 8 & 1:
                best, value = length, units[at] & 0x7FFFFFFF
        if not best:
            return 0, b""
        return best, self.replacements[value:self.replacements.index(b"\0", value)]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix at a place (0: none) and its replacement."""
        # A key is a few characters long, so a short window decides nearly always.
        length, text = self._short(data[at:at + 16])
        if length == 16:
            length, text = self._short(data[at:at + 512])
        return length, text


@dataclass
class Normalizer:
    """Normalised bytes and, for each boundary between them, the original place."""

    characters: CharacterMap | None
    dummy_prefix: bool
    drop_extra_spaces: bool
    mark_spaces: bool

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int32)
        if self.characters is None and not self.drop_extra_spaces:
            return self._copied(data)
        return self._walked(data)

    def _copied(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only spaces change."""
        prefix = b" " * self.dummy_prefix
        wide = prefix + data
        places = np.arange(-len(prefix), len(data) + 1, dtype=np.int32)
        np.maximum(places, 0, out=places)
        if not self.mark_spaces:
            return wide, places
        widths = np.ones(len(wide) + 1, np.int32)
        widths[:-1][np.frombuffer(wide, np.uint8) == 0x20] = len(MARK)
        return wide.replace(b" ", MARK), np.repeat(places, widths)

    def _walked(self, data: bytes) -> tuple[bytes, np.ndarray]:
        parts, places, at, end = [], [], 0, len(data)
        space = MARK if self.mark_spaces else b" "
        while at < end:
            length, text = self.characters.longest(data, at) if self.characters else (0, b"")
            if not length:
                lead = data[at]
                length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                text = data[at:at + length]
            parts.append((text, at, at + length))
            at += length
        out = []
        if self.drop_extra_spaces:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
            while parts and not parts[-1][0].strip(b" "):
                parts.pop()
        if not parts:
            return b"", np.zeros(1, np.int32)
        if self.dummy_prefix:
            out.append(space)
            places += [parts[0][1]] * len(space)
        after_space = self.drop_extra_spaces
        for text, start, _ in parts:
            for i in range(len(text)):
                byte = text[i:i + 1]
                if byte == b" ":
                    if self.drop_extra_spaces and after_space:
                        continue
                    byte = space
                after_space = byte == space
                out.append(byte)
                places += [start] * len(byte)
        last = parts[-1][2]
        joined = b"".join(out)
        if self.drop_extra_spaces:
            kept = len(joined)
            while joined[:kept].endswith(space):
                kept -= len(space)
                last = places[kept]
            joined, places = joined[:kept], places[:kept]
        return joined, np.array([*places, last], np.int32)


class Codec:
    """One model, loaded in one process."""

    def __init__(self, blob: bytes):
        proto = model_pb.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        self.normalizer = Normalizer(
            CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None,
            spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.end = self.library.eos_id()
        texts = [p.piece for p in proto.pieces]
        self.pieces = [self._bytes(p.piece, p.type) for p in proto.pieces]
        self.unknown = self.library.unk_id()
        self.sizes = np.array([
            1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], np.int32)
        whole = any(SPACE_MARK in t.lstrip(SPACE_MARK) for t in texts)
        newline = "" if any("\n" in t for t in texts) else "\n"
        self.chunk = None if whole else re.compile(
            f"{SPACE_MARK}*[^{SPACE_MARK}{newline}]+|{SPACE_MARK}+" + (f"|{newline}" if newline else ""))
        # For text that is normalised already.
        spec.precompiled_charsmap, spec.normalization_rule_tsv = b"", ""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.known: dict[str, bytes] = {}
        # The one piece that a newline always is, if chunks end at newlines.
        lone = self.merger.encode("\n", out_type=int) if newline else []
        self.divider = lone[0] if len(lone) == 1 and proto.pieces[lone[0]].type == BYTE else None

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return piece.replace(SPACE_MARK, " ").encode()

    def _merge(self, chunks: list[str]) -> dict[str, bytes]:
        if self.divider is not None and "\n" not in chunks:
            # One call for all, as the library takes longer to begin a text than to merge a chunk.
            ids = np.array(self.merger.encode("\n".join(chunks), out_type=int, num_threads=1), np.int32)
            data, size = ids.tobytes(), ids.itemsize
            ends = [*(np.flatnonzero(ids == self.divider) * size).tolist(), len(data)]
            if len(ends) == len(chunks):
                return {c: data[a:b] for c, a, b in zip(chunks, [0, *[e + size for e in ends]], ends)}
        found = self.merger.encode(chunks, out_type=int, num_threads=1)
        return {c: np.array(ids, np.int32).tobytes() for c, ids in zip(chunks, found, strict=True)}

    def ids(self, normal: str) -> np.ndarray:
        """Ids of a normalised text."""
        if not normal:
            return np.zeros(0, np.int32)
        chunks = self.chunk.findall(normal) if self.chunk else [normal]
        known = self.known
        new = set(chunks).difference(known)
        if new:
            short = [c for c in new if len(c) <= REMEMBERED_LENGTH]
            long = [c for c in new if len(c) > REMEMBERED_LENGTH]
            if len(known) + len(short) > REMEMBERED_CHUNKS:
                known.clear()
                short = [c for c in set(chunks) if len(c) <= REMEMBERED_LENGTH]
            known.update(self._merge(short))
            if long:
                known = {**{c: known[c] for c in chunks if c in known}, **self._merge(long)}
        return np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.int32)

    def encode(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with an end id, and the start and end byte of each in the original."""
        data = text or b""
        normal, places = self.normalizer(data)
        ids = self.ids(normal.decode())
        sizes = self.sizes[ids]
        if (unknown := ids == self.unknown).any():
            pieces = self.merger.encode(normal.decode(), out_type=str)
            sizes = np.where(unknown, [len(p.encode()) for p in pieces], sizes)
        cuts = places[np.concatenate(([0], np.cumsum(sizes)))]
        last = np.int32(len(data))
        return (np.append(ids, np.int32(self.end)), np.append(cuts[:-1], last), np.append(cuts[1:], last))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces put together, no space in front."""
        pieces = self.pieces
        data = b"".join([pieces[i] for i in ids])
        if self.normalizer.drop_extra_spaces or self.unknown in ids:
            return self.library.decode(ids)
        if self.normalizer.dummy_prefix and data[:1] == b" ":
            first = next((i for i in ids if pieces[i]), None)
            if first is not None and pieces[first][:1] == b" " and self.sizes[first] > 1:
                data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:  # byte pieces that are no character
            return self.library.decode(ids)


@functools.lru_cache(maxsize=2)
def _codec(blob: bytes) -> Codec:
    return Codec(blob)


def _model(df: DataFrame, path: str):
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MAX_MODEL_BYTES} bytes")
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (), decoded: bool = False,
) -> DataFrame:
    """(id, ids, starts, ends) per row: ids with an end id, and their original byte spans.

    The columns named in ``keep`` follow, and with ``decoded`` what ``decode`` makes of the ids:
    the same task decodes them, so an executor runs one Python worker a core instead of two.
    """
    model = _model(docs, model_path)
    # The text goes to Python once, kept or not.
    source = ["text" if c == text_col else f"keep_{i}" for i, c in enumerate(keep)]
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"),
                      *[docs[c].alias(s) for c, s in zip(keep, source, strict=True) if s != "text"])
    schema = T.StructType([
        own.schema["id"], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends")],
        *[T.StructField(f"keep_{i}", own.schema[s].dataType) for i, s in enumerate(source)],
        *[T.StructField("decoded", T.StringType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        names = [f.name for f in schema.fields]
        for batch in batches:
            begin, found, size = 0, [], 0

            def flush():
                part = batch.slice(begin, len(found))  # noqa: B023
                lists = [_lists(list(c)) for c in zip(*found, strict=True)]  # noqa: B023
                texts = [pa.array([codec.decode(c[0].tolist()) for c in found], pa.string())] if decoded else []  # noqa: B023
                return pa.RecordBatch.from_arrays(
                    [part.column("id"), *lists, *[part.column(s) for s in source], *texts], names)

            for _, text in utf8_rows(batch):
                found.append(codec.encode(text))
                size += len(text or b"")
                if size > BATCH_BYTES:
                    yield flush()
                    begin, found, size = begin + len(found), [], 0
            if found:
                yield flush()

    out = own.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "ids", "starts", "ends",
                      *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *["decoded"] * decoded)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``; all its columns stay."""
    model = _model(encoded, model_path)
    out = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    schema = T.StructType([*out.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            texts = []
            lists = batch.column(batch.schema.get_field_index(ids_col))
            for ids in lists:
                texts.append(codec.decode(ids.values.to_numpy().tolist() if ids.is_valid else []))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return out.mapInArrow(run, schema)


def span_bytes(starts: str = "starts", ends: str = "ends"):
    """Original bytes that the spans of a row cover."""
    return F.aggregate(
        F.arrays_zip(F.col(starts).alias("a"), F.col(ends).alias("b")), F.lit(0).cast("long"),
        lambda total, s: total + (s["b"] - s["a"]).cast("long"))
