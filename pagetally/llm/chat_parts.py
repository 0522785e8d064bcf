"""Chat formatting of messages with typed content parts, and reading the result back.

A message is a list of parts. A visitor flattens them in order: text is escaped and kept,
an image, an audio clip or a document becomes a numbered placeholder, and its reference
and the number of tokens it will expand to are recorded. Numbers run through a conversation,
however its turns are dealt out: attachments are counted in each range of turns, and each range
starts at the sum of those before it. The template puts marks around each
turn; assistant texts are recorded as spans of a loss mask.

Control strings all begin with ``<|``. In texts and roles every ``<`` that is followed by
backslashes (or none) and ``|`` gets one more backslash, so no text can hold a control
string, and taking one backslash away gives the text back.

Turns are dealt out in ranges of (conversation, turn), so a conversation with very many turns is
formatted by many tasks, each making segments of bounded size. Reading back streams the
segments of a conversation in order and holds one at a time.

Defined results: a null text or role is empty; turns that are null come first; rows of the
same turn are ordered by role and then content; a null part is an empty text; rows with a null conversation id are one
conversation; a conversation is never empty, so an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetally.llm.common import partitions_of, record_batch
from pagetally.sources.tables import materialize

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
SEGMENT_CHARS = 1 << 20
ATTACHED = ("image", "audio", "document")
PARTS = ("array<struct<type:string,text:string,ref:string,width:int,height:int,"
         "seconds:double,pages:int>>")

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """Roles end at a newline, so theirs are escaped too."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass(frozen=True)
class Costs:
    """How many tokens an attachment expands to."""

    image_patch: int = 14
    image_max_side: int = 1568
    audio_per_second: float = 25.0
    document_per_page: int = 1024


@dataclass
class Flattener:
    """Visits the parts of one message after the other; ``next`` is the number of the next attachment."""

    costs: Costs = field(default_factory=Costs)
    attachments: list[dict] = field(default_factory=list)
    next: int = 0

    def visit(self, part: dict | None) -> str:
        part = part or {}
        kind = part.get("type") or "text"
        handler = getattr(self, f"visit_{kind}", None)
        if handler is None:
            raise ValueError(f"unknown content part {kind!r}")
        return handler(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        width, height = max(1, part.get("width") or 1), max(1, part.get("height") or 1)
        shrink = min(1.0, self.costs.image_max_side / max(width, height))
        side = lambda n: max(1, math.ceil(n * shrink / self.costs.image_patch))
        return self._attach("image", part, side(width) * side(height))

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.costs.audio_per_second))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, (part.get("pages") or 0) * self.costs.document_per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        number, self.next = self.next, self.next + 1
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}_{number}|>"


def text_part(text: Column) -> Column:
    """A message that is one text, as a list of parts."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(
        F.lit("text").alias("type"), text.cast("string").alias("text"), null("string").alias("ref"),
        null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"),
        null("int").alias("pages")))


def _first_numbers(turns: DataFrame) -> DataFrame:
    """(at, first): the number of the first attachment of each turn that has one.

    ``turns`` is a written table whose ``at`` ascends in ranges of (conversation, turn). Windows
    hold the turns of one conversation in one range, or one row per range.
    """
    n = F.size(F.filter("parts", lambda p: p["type"].isin(*ATTACHED))).cast("long")
    held = turns.select("at", "conv", F.shiftright("at", 33).alias("part"), n.alias("n")).where("n > 0")
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = held.groupBy("conv", "part").agg(F.sum("n").alias("n")).select(
        F.col("conv").alias("whose"), F.col("part").alias("range"),
        F.coalesce(F.sum("n").over(before(["conv"], "part")), F.lit(0)).alias("shift"))
    inside = held.withColumn("inside", F.coalesce(F.sum("n").over(before(["conv", "part"], "at")), F.lit(0)))
    same = (inside["part"] == sizes["range"]) & inside["conv"].eqNullSafe(sizes["whose"])
    return materialize(inside.join(sizes, same).select("at", (F.col("inside") + F.col("shift")).alias("first")), "numbers")


def format_turns(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    parts_col: str = "parts", costs: Costs | None = None,
) -> DataFrame:
    """Segments of formatted conversations.

    (conv, at, formatted, loss, attachments): segments of a conversation follow one
    another by ``at``; ``loss`` are spans of code points in ``formatted``. The ranges of turns
    are written once, so that what they are numbered by stays the same when a task runs again.
    """
    costs = costs or Costs()
    rows = messages.select(
        messages[conv_col].alias("conv"), messages[turn_col].alias("turn"),
        F.coalesce(messages[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(messages[parts_col], F.array()).cast(PARTS).alias("parts"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "parts")]
    parts = partitions_of(messages.sparkSession)
    turns = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                        .withColumn("at", F.monotonically_increasing_id()), "turns")
    numbered = turns.join(_first_numbers(turns), "at", "left")
    dealt = numbered.repartitionByRange(parts, "at").sortWithinPartitions("at")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 40, 0
        conv, pieces, size, spans = None, [], 0, []
        flat = Flattener(costs)

        def flush(conv_type: pa.DataType) -> pa.RecordBatch:
            nonlocal made, pieces, size, spans, flat
            out = pa.schema([
                ("conv", conv_type), ("at", pa.int64()), ("formatted", pa.string()),
                ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ("attachments", pa.list_(pa.struct([
                    ("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))])
            batch = record_batch(out, [[conv], [base + made], ["".join(pieces)], [spans], [flat.attachments]])
            made, pieces, size, spans, flat = made + 1, [], 0, [], Flattener(costs)
            return batch

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for own, role, parts, first in zip(
                    *(batch.column(c) for c in ("conv", "role", "parts", "first")), strict=True):
                own = own.as_py()
                if pieces and (own != conv or size > SEGMENT_CHARS):
                    yield flush(conv_type)
                conv = own
                head, flat.next = f"{START}{escape_role(role.as_py())}\n", first.as_py() or 0
                body = "".join(flat.visit(p) for p in parts.as_py())
                if role.as_py() == LOSS_ROLE:
                    spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
                pieces.append(f"{head}{body}{END}\n")
                size += len(pieces[-1])
        if pieces:
            yield flush(conv_type)

    return dealt.mapInArrow(run, (
        f"conv {kind}, at long, formatted string, loss array<struct<start:long,end:long>>, "
        "attachments array<struct<number:int,kind:string,ref:string,tokens:long>>"))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn; placeholders of attachments stay as they are."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn does not begin with its mark")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield unescape_role(formatted[at + len(START):line]), unescape(formatted[line + 1:end])
        at = end + len(END) + 1


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and its loss mask alone.

    (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments,
    attachment_tokens).
    """
    segments = materialize(segments, "segments")
    kind = segments.schema["conv"].dataType.simpleString()
    dealt = segments.repartition(partitions_of(segments.sparkSession), "conv").sortWithinPartitions("conv", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, rows, conv_type = None, False, [], None
        turns = loss = None
        counts = [0] * 5

        def schema() -> pa.Schema:
            return pa.schema([
                ("conv", conv_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()),
                ("attachment_tokens", pa.int64())])

        def close() -> None:
            rows.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), *counts[2:]))

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for own, text, spans, attached in zip(
                    *(batch.column(c) for c in ("conv", "formatted", "loss", "attachments")), strict=True):
                own, text = own.as_py(), text.as_py()
                if not open_ or own != conv:
                    if open_:
                        close()
                    conv, open_, counts = own, True, [0] * 5
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    counts[0] += 1
                for span in spans.as_py():
                    said = unescape(text[span["start"]:span["end"]])
                    loss.update(said.encode())
                    counts[1] += len(said)
                counts[2] += len(text)
                for a in attached.as_py():
                    counts[3] += 1
                    counts[4] += a["tokens"]
            if rows:
                yield record_batch(schema(), [list(c) for c in zip(*rows, strict=True)])
                rows.clear()
        if open_:
            close()
            yield record_batch(schema(), [list(c) for c in zip(*rows, strict=True)])

    return dealt.mapInArrow(run, (
        f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_attachments long, attachment_tokens long"))
