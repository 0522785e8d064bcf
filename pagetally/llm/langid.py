"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point, so no
alphabet has to be listed. A three-letter sequence is the elementwise product of its
letters' vectors, the first rotated by two places and the second by one. A text is
the sum of its sequences' vectors, and a language's prototype the sum of its training texts.
The cosine with each prototype decides, after the mean direction of all prototypes has been
taken out of both, since most of what a text holds is common to all languages.

Prototypes use every training row: tasks add up letter-sequence counts and send one packed
integer vector per language, which are added up in two levels, so the sums do not depend on order or
partitioning. Only one vector per language reaches the driver and the tasks that identify, 8 KB each;
there may be any number of labels.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is
every text if nothing was learned; rows without a label are not learned from; equal cosines
go to the first label in order; repeated ids are judged row by row; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import id_type, partitions_of, record_batch, slim

DIMENSIONS = 1024
SEED = 20250101
# Languages whose sums a task holds at a time, and tasks that a language's sums meet in first.
LANGUAGES_AT_ONCE = 4096
SPREAD = 16
UNKNOWN = "und"
SEQUENCES_AT_ONCE = 4096
TEXTS_AT_ONCE = 256
CHARS_AT_ONCE = 4_000_000
# A gap between words counts as one letter.
GAP = 0x20


def _letters(text: str) -> np.ndarray:
    """Code points of a text in lower case, every run of other characters one gap."""
    if text.isascii():
        points = np.frombuffer(text.lower().encode("ascii"), np.uint8).astype(np.int64)
        letter = (points >= 0x61) & (points <= 0x7A)
    else:
        low = text.lower()
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letter = (points >= 0x61) & (points <= 0x7A)
        for p in np.unique(points[points >= 0x80]).tolist():
            if chr(p).isalpha():
                letter |= points == p
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, GAP)
    # A gap before the first letter and after the last.
    points = np.concatenate(([GAP], points, [GAP]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != GAP) | (points[:-1] != GAP)
    return points[keep]


def sequences(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Three-letter sequences of a text, packed in 63 bits, and how often each occurs."""
    points = _letters(text or "")
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)


class Space:
    """Vectors of letters and of their sequences."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.known: dict[int, np.ndarray] = {}

    def letter(self, point: int) -> np.ndarray:
        vector = self.known.get(point)
        if vector is None:
            bits = np.random.Generator(np.random.PCG64([self.seed, point])).integers(0, 2, self.dimensions, np.int8)
            vector = self.known[point] = bits * np.int8(2) - np.int8(1)
        return vector

    def vectors(self, packed: np.ndarray) -> np.ndarray:
        """One row of +1 and -1 for each packed sequence."""
        out = None
        for shift, turn in ((42, 2), (21, 1), (0, 0)):
            points, where = np.unique(packed >> shift & 0x1FFFFF, return_inverse=True)
            table = np.stack([np.roll(self.letter(p), turn) for p in points.tolist()])[where]
            out = table if out is None else out * table
        return out

    def bundle(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The sum of the vectors of each text's sequences, one row per text."""
        out = np.zeros((len(texts), self.dimensions), np.float64)
        if not any(len(p) for p, _ in texts):
            return out
        every = np.unique(np.concatenate([p for p, _ in texts]))
        places = [np.searchsorted(every, p) for p, _ in texts]
        for start in range(0, len(every), SEQUENCES_AT_ONCE):
            part = self.vectors(every[start:start + SEQUENCES_AT_ONCE]).astype(np.float32)
            for row, (place, (_, counts)) in enumerate(zip(places, texts, strict=True)):
                a, b = np.searchsorted(place, (start, start + SEQUENCES_AT_ONCE))
                if a < b:
                    out[row] += counts[a:b].astype(np.float32) @ part[place[a:b] - start]
        return out


@dataclass(frozen=True)
class Profiles:
    """Centred prototypes of unit length, one row per language in label order."""

    labels: tuple[str, ...]
    mean: np.ndarray
    rows: np.ndarray
    dimensions: int = DIMENSIONS
    seed: int = SEED

    def predict(self, vectors: np.ndarray) -> tuple[list[str], list[float]]:
        """Label and score of each row; scores are cosines moved to 0..1."""
        out_labels, out_scores = [], []
        for vector in vectors:
            length = np.linalg.norm(vector)
            if not self.labels or not length:
                out_labels.append(UNKNOWN)
                out_scores.append(0.0)
                continue
            moved = vector / length - self.mean
            size = np.linalg.norm(moved)
            cosines = self.rows @ moved / size if size else np.zeros(len(self.labels))
            best = int(np.argmax(cosines))
            out_labels.append(self.labels[best])
            out_scores.append(float(min(1.0, max(0.0, (1 + cosines[best]) / 2))))
        return out_labels, out_scores


def held_out(key: Column) -> Column:
    """The quarter of ids that is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
    dimensions: int = DIMENSIONS, seed: int = SEED,
) -> Profiles:
    """Prototypes from every row that has a text and a label."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
        space = Space(dimensions, seed)
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                texts.setdefault(lang.as_py(), []).append(text.as_py())
            for lang, own in texts.items():
                total = np.zeros(dimensions, np.int64)
                for packed, counts in _joined(own):
                    for i in range(0, len(packed), SEQUENCES_AT_ONCE):
                        part = space.vectors(packed[i:i + SEQUENCES_AT_ONCE]).astype(np.float64)
                        total += np.rint(counts[i:i + SEQUENCES_AT_ONCE] @ part).astype(np.int64)
                yield lang, total

    def add_up(vectors: Iterator[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """One row per language; more than ``LANGUAGES_AT_ONCE`` are sent on in parts."""
        sums: dict[str, np.ndarray] = {}
        for lang, vector in vectors:
            if lang in sums:
                sums[lang] += vector
            else:
                sums[lang] = vector.copy()
            if len(sums) == LANGUAGES_AT_ONCE:
                yield _sums_batch(sums)
                sums = {}
        yield _sums_batch(sums)

    def packed_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
        for batch in batches:
            for lang, vector in zip(batch.column("lang"), batch.column("vector"), strict=True):
                yield lang.as_py(), np.frombuffer(vector.as_py(), np.int64)

    schema = "lang string, vector binary"
    sent = rows.mapInArrow(lambda batches: add_up(count(batches)), schema)
    # A language's vectors meet in several tasks first, so the last sum has a few rows of each.
    for keys in (("lang", F.pmod(F.xxhash64("vector"), F.lit(SPREAD))), ("lang",)):
        sent = sent.repartition(partitions_of(docs.sparkSession), *keys).mapInArrow(
            lambda batches: add_up(packed_sums(batches)), schema)
    sums: dict[str, np.ndarray] = {}
    for r in sent.toLocalIterator():
        sums[r.lang] = sums.get(r.lang, 0) + np.frombuffer(r.vector, np.int64)
    labels = tuple(sorted(k for k, v in sums.items() if v.any()))
    if not labels:
        return Profiles((), np.zeros(dimensions), np.zeros((0, dimensions)), dimensions, seed)
    unit = np.stack([sums[k] / np.linalg.norm(sums[k]) for k in labels])
    mean = unit.mean(0) if len(labels) > 1 else np.zeros(dimensions)
    moved = unit - mean
    sizes = np.linalg.norm(moved, axis=1, keepdims=True)
    return Profiles(labels, mean, moved / np.where(sizes > 0, sizes, 1), dimensions, seed)


def _sums_batch(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    out = pa.schema([("lang", pa.string()), ("vector", pa.binary())])
    return record_batch(out, [list(sums), [v.tobytes() for v in sums.values()]])


def _joined(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts over several texts at a time; sequences never cross from one to the next."""
    held, size = [], 0
    for text in texts:
        points = _letters(text)
        if len(points) >= 3:
            held.append(points[:-2] << 42 | points[1:-1] << 21 | points[2:])
            size += len(points)
        if size > CHARS_AT_ONCE:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def identify(
    docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, lang_pred, score) per row; only the text is looked at."""
    schema = f"id {id_type(docs, id_col)}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(profiles.dimensions, profiles.seed)
        for batch in batches:
            out = pa.schema([pa.field("id", batch.schema.field("id").type),
                             ("lang_pred", pa.string()), ("score", pa.float64())])
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(i, TEXTS_AT_ONCE)
                counted = [sequences(t.as_py()) for t in part.column("text")]
                labels, scores = profiles.predict(space.bundle(counted))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(labels, pa.string()), pa.array(scores)], schema=out)

    return slim(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
