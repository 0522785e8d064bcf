"""Quality rules: counted rules, then a linear-chain CRF that labels each line.

Every line with a word is described by yes-or-no features and labelled content or
boilerplate by Viterbi decoding of a two-label linear-chain conditional random field.
A document is kept if it passes the counted rules and content lines hold at least
``min_content`` of its words.

The field is fitted by maximum likelihood on a bounded sample of labelled documents:
``per_class`` ids of each quality, those with the smallest hashes, one row of each id (the one whose
lines' features have the smallest hash) and ``SAMPLED_SEGMENTS`` segments of ``SEGMENT_LINES`` lines
of each row, spread evenly over all of its lines. Which of these lines are content is latent: the
quality of their document only makes it likelier or less (``CONTENT_ODDS``), and
expectation-maximisation settles it, so a bad document may hold content and a good one boilerplate.
At most four bytes for each of these lines reach the driver, however often an id is repeated or
however long a text is. Without both qualities in the labels the fixed ``PRIOR`` weights are used.

Defined results: a null or empty text has no words and fails the counted rules; repeated
ids are judged row by row; an empty table gives no rows; a tie in decoding goes to content.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import id_type, record_batch, slim, utf8_rows

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))
# Words that site furniture is made of.
FURNITURE = frozenset(
    b"cookie cookies login signup subscribe newsletter copyright javascript sitemap "
    b"unsubscribe click menu share advertisement".split())

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT = 0.5
PER_CLASS = 1000
SEGMENT_LINES = 64
SAMPLED_SEGMENTS = 8
# Log-odds that a line is content in a bad and in a good document, before its features are known.
CONTENT_ODDS = (-0.25, 2.0)
ROUNDS = 4

FEATURES = (
    "always", "shouted", "some symbols", "many symbols", "digits", "exclaims",
    "few distinct words", "some repeated words", "stutters", "short words", "long words",
    "ends a sentence", "one to three words", "four to nine words", "over a hundred words",
    "seen before", "furniture",
)
# Log-odds of content for each feature, used when there is nothing to learn from.
PRIOR = (2.0, -3.0, -1.0, -3.0, -0.5, -2.0, -3.0, -1.0, -3.0, -0.5, -0.5, 0.5, -0.5, 0.0, 0.0, -0.5, -1.0)


@dataclass(frozen=True)
class Field:
    """A two-label linear-chain field; label 1 is content."""

    weights: tuple[float, ...] = PRIOR
    # transitions[a][b]: score of label b after label a
    transitions: tuple[tuple[float, float], tuple[float, float]] = ((0.7, 0.0), (0.0, 0.7))


@dataclass(frozen=True)
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return (self.n_words < MIN_WORDS
                or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    if len(windows) == max(0, len(words) - 2):
        return 0
    total, covered = 0, 0
    for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if windows[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def line_features(line: bytes, words: list[bytes], seen: bool) -> int:
    """The features of one line as bits, in the order of ``FEATURES``."""
    n, size = len(words), len(line)
    upper = size - len(line.translate(None, UPPER))
    lower = size - len(line.translate(None, LOWER))
    symbols = size - len(line.translate(None, SYMBOLS))
    digits = size - len(line.translate(None, DIGITS))
    distinct = len(set(words))
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    checks = (
        True,
        upper > 1.5 * lower and upper > 3,
        symbols * 50 > size,
        symbols * 5 > n,
        digits * 8 > size,
        line.count(b"!!") * 5 > n,
        n >= 10 and distinct * 3 < n,
        n >= 10 and distinct * 2 < n,
        stutter * 4 > n,
        size < 4 * n,
        size > 12 * n,
        words[-1][-1:] in (b".", b"!", b"?", b":", b'"'),
        n <= 3,
        4 <= n <= 9,
        n > 100,
        seen,
        not FURNITURE.isdisjoint(words),
    )
    return sum(1 << i for i, yes in enumerate(checks) if yes)


def read_document(text: bytes | None) -> tuple[Counts, list[int], list[int]]:
    """Counts, the feature bits of each line with a word, and each such line's words."""
    data = text or b""
    words = data.split()
    seen: set[bytes] = set()
    bits, sizes, dup = [], [], 0
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            again = line in seen
            dup += again
            seen.add(line)
            bits.append(line_features(line, own, again))
            sizes.append(len(own))
    counts = Counts(
        n_words=len(words),
        word_chars=len(data.translate(None, SPACE + CONTINUATION)),
        n_symbols=len(data) - len(data.translate(None, SYMBOLS)),
        n_dup_lines=dup,
        n_repeat_words=repeated_words(words),
    )
    return counts, bits, sizes


class Decoder:
    """Viterbi decoding; the score of a set of features is looked up."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[int, float] = {}

    def emission(self, bits: int) -> float:
        score = self.known.get(bits)
        if score is None:
            score = self.known[bits] = sum(
                w for i, w in enumerate(self.field.weights) if bits >> i & 1)
        return score

    def labels(self, lines: list[int]) -> list[int]:
        """The best labels of a sequence of lines; 1 is content."""
        if not lines:
            return []
        (t00, t01), (t10, t11) = self.field.transitions
        zero, one = 0.0, self.emission(lines[0])
        back = [(0, 1)]
        for bits in lines[1:]:
            stay, come = zero + t00, one + t10
            to_zero = (come, 1) if come >= stay else (stay, 0)
            come, stay = zero + t01, one + t11
            to_one = (stay, 1) if stay >= come else (come, 0)
            zero, one = to_zero[0], to_one[0] + self.emission(bits)
            back.append((to_zero[1], to_one[1]))
        label = 1 if one >= zero else 0
        found = [label]
        for step in reversed(back[1:]):
            label = step[label]
            found.append(label)
        return found[::-1]


def _marginals(
    emit: np.ndarray, transitions: np.ndarray, inside: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all sequences at once.

    ``emit`` and ``inside`` are (line, sequence). Gives the probability of content of each line
    and that of each pair of labels of neighbours, (label, next label, line, sequence); zero outside.
    """
    top = np.maximum(emit, 0)
    seen = np.stack([np.exp(-top), np.exp(emit - top)])
    move = np.exp(transitions - transitions.max())
    ahead, behind = np.empty_like(seen), np.empty_like(seen)
    ahead[:, 0] = seen[:, 0] / seen[:, 0].sum(0)
    for i in range(1, len(emit)):
        moved = (move.T @ ahead[:, i - 1]) * seen[:, i]
        ahead[:, i] = moved / moved.sum(0)
    behind[:, -1] = 0.5
    for i in range(len(emit) - 2, -1, -1):
        moved = move @ (seen[:, i + 1] * behind[:, i + 1])
        behind[:, i] = np.where(inside[i + 1], moved / moved.sum(0), 0.5)
    both = ahead * behind
    pairs = ahead[:, None, :-1] * move[:, :, None, None] * (seen * behind)[None, :, 1:]
    pairs *= inside[1:] / pairs.sum((0, 1))
    return both[1] / both.sum(0) * inside, pairs


def train(
    sequences: list[tuple[list[int], int]], rounds: int = ROUNDS, steps: int = 60,
    rate: float = 0.2, l2: float = 0.001,
) -> Field:
    """Fit the field to (feature bits of each line, quality of the document).

    The labels of lines are latent. The first field takes each line for itself, labelled as its document;
    each of ``rounds`` rounds then expects labels from the field and ``CONTENT_ODDS`` of the
    document's quality by forward-backward, and fits the field to them by gradient ascent.
    Long documents are cut into segments of ``SEGMENT_LINES`` lines for fitting only.
    """
    pieces = [(bits[i:i + SEGMENT_LINES], label) for bits, label in sequences
              for i in range(0, len(bits), SEGMENT_LINES)]
    if len({label for _, label in pieces}) < 2:
        return Field()
    longest = max(len(bits) for bits, _ in pieces)
    packed = np.zeros((longest, len(pieces)), np.int64)
    inside = np.zeros((longest, len(pieces)), bool)
    for row, (bits, _) in enumerate(pieces):
        packed[:len(bits), row] = bits
        inside[:len(bits), row] = True
    patterns, place = np.unique(packed, return_inverse=True)
    place = place.reshape(packed.shape)
    table = (patterns[:, None] >> np.arange(len(FEATURES)) & 1).astype(np.float64)
    y = np.array([label for _, label in pieces])
    # Each quality has the same say, whatever its number of lines.
    lines_of = [inside[:, y == k].sum() for k in (0, 1)]
    weight = np.where(y == 1, 0.5 / lines_of[1], 0.5 / lines_of[0])
    known = np.where(y == 1, *CONTENT_ODDS[::-1])
    w, t = np.zeros(len(FEATURES)), np.zeros((2, 2))
    content, pairs = inside * (y == 1), None
    for _ in range(rounds + 1):
        if pairs is not None:
            content, pairs = _marginals((table @ w)[place] + known, t, inside)
        want = np.bincount(place.ravel(), (content * weight).ravel(), len(patterns))
        want_t = np.zeros((2, 2)) if pairs is None else (pairs * weight).sum((2, 3))
        first, second = np.zeros(w.size + 4), np.zeros(w.size + 4)
        for step in range(1, steps + 1):
            found, met = _marginals((table @ w)[place], t, inside)
            have = np.bincount(place.ravel(), (found * weight).ravel(), len(patterns))
            grad_t = np.zeros((2, 2)) if pairs is None else want_t - (met * weight).sum((2, 3)) - l2 * t
            grad = np.concatenate([table.T @ (want - have) - l2 * w, grad_t.ravel()])
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad ** 2
            move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
            w, t = w + move[:w.size], t + move[w.size:].reshape(2, 2)
        pairs = met
    return Field(tuple(w.tolist()), tuple(map(tuple, t.tolist())))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    quality_col: str = "quality", per_class: int = PER_CLASS,
) -> Field:
    """Fit on at most ``per_class`` labelled rows of each quality (0 bad, 1 good).

    Rows without an id or a quality, and ids without a row, teach nothing; an id with both
    qualities counts for both.
    """
    chosen = None
    for quality in (0, 1):
        own = (labels.where(labels[quality_col] == quality)
               .select(labels[id_col].alias("key"), F.lit(quality).alias("quality"))
               .where("key IS NOT NULL").distinct()
               .orderBy(F.xxhash64("key"), "key").limit(per_class))
        chosen = own if chosen is None else chosen.union(own)
    sample = slim(docs, id_col, text_col)
    # At most 2 * per_class ids.
    sample = sample.join(F.broadcast(chosen), sample["id"] == chosen["key"]).select("key", "quality", "text")
    kind = sample.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([batch.schema.field("key"), ("quality", pa.int32()), ("bits", pa.list_(pa.int32()))])
            texts = batch.column("text").cast(pa.large_binary())
            yield record_batch(out, [
                batch.column("key").to_pylist(), batch.column("quality").to_pylist(),
                [sampled_lines(read_document(t.as_py())[1]) for t in texts]])

    found = sample.mapInArrow(run, f"key {kind}, quality int, bits array<int>").where(F.size("bits") > 0)
    rows = found.groupBy("key", "quality").agg(F.min(F.struct(F.xxhash64("bits").alias("hash"), "bits")).alias("one"))
    # In a fixed order, so that the same rows give the same field.
    return train(sorted((list(r.bits), r.quality) for r in rows.select("quality", "one.bits").collect()))


def sampled_lines(lines: list[int]) -> list[int]:
    """All of a few lines; of many, segments spread evenly over them."""
    if len(lines) <= SAMPLED_SEGMENTS * SEGMENT_LINES:
        return lines
    starts = [i * (len(lines) - SEGMENT_LINES) // (SAMPLED_SEGMENTS - 1) for i in range(SAMPLED_SEGMENTS)]
    return [bits for a in starts for bits in lines[a:a + SEGMENT_LINES]]


def judge(
    docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text",
    min_content: float = MIN_CONTENT,
) -> DataFrame:
    """Counts, verdict and line labels per row of ``docs``.

    ``line_labels`` has a character per line with a word: C for content, b for boilerplate.
    """
    schema = (f"id {id_type(docs, id_col)}, n_words long, word_chars long, n_symbols long, "
              "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
              "content_words long, line_labels string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            out = pa.schema([
                pa.field("id", batch.schema.field("id").type),
                *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                ("base_failed", pa.bool_()), ("kept", pa.bool_()),
                ("content_words", pa.int64()), ("line_labels", pa.string()),
            ])
            rows = []
            for key, text in utf8_rows(batch):
                counts, bits, sizes = read_document(text)
                found = decoder.labels(bits)
                content = sum(n for n, label in zip(sizes, found, strict=True) if label)
                kept = not counts.failed and content >= min_content * counts.n_words
                rows.append((
                    key, counts.n_words, counts.word_chars, counts.n_symbols, counts.n_dup_lines,
                    counts.n_repeat_words, counts.failed, kept, content,
                    "".join("C" if label else "b" for label in found)))
            yield record_batch(out, [list(c) for c in zip(*rows, strict=True)] or [[] for _ in out])

    return slim(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_good(
    docs: DataFrame, field: Field, text_col: str = "text", min_content: float = MIN_CONTENT,
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns and nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
            mask = []
            for text in texts:
                counts, bits, sizes = read_document(text.as_py())
                found = decoder.labels(bits)
                content = sum(n for n, label in zip(sizes, found, strict=True) if label)
                mask.append(not counts.failed and content >= min_content * counts.n_words)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
