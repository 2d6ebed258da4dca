"""Chat formatting with a template that is known by its outputs only.

The template is a function from turns to text. Successive prefixes of a conversation are
rendered; where an output continues the one before it, what it adds is the span of the new
turn, and where it does not, the template rewrites history. The part of a span that holds the
turn's text is found by rendering the same prefix with one unused character as that text.

A template is rendered on the true prefixes of the whole conversation, so its work grows with
the square of the turns. Only a ``PerTurn`` template, whose output is by construction that of
its turns one after the other, is rendered in segments of SEGMENT_TURNS turns: what it adds for
a turn is the same with and without the turns before, so the segments' outputs one after the
other are the conversation's, and the work per turn and the memory of a task are bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_TURNS = 256
ROWS_OUT = 256


class Turn(NamedTuple):
    role: str
    text: str


class Span(NamedTuple):
    """Code points of a turn in the output, and those of its text in it."""

    start: int
    end: int
    text_start: int
    text_end: int


class Rendered(NamedTuple):
    text: str
    spans: list[Span]
    rewrites_history: bool


Template = Callable[[list[Turn]], str]


@dataclass(frozen=True)
class PerTurn:
    """The template that shows each turn by ``shown``, whatever turns are around it."""

    shown: Callable[[Turn], str]

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(map(self.shown, turns))


_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"
# A line end in a role; escaped texts hold no "<|".
_LINE_END = "<|n|>"


def escaped(text: str) -> str:
    """``text`` without control strings: each "<" that a "|" or "\\" follows gets a "\\" behind it."""
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    """The text that ``escaped`` made this of."""
    parts, at = [], 0
    while (found := text.find("<\\", at)) >= 0:
        parts.append(text[at : found + 1])
        # What follows the mark belongs to the text, be it another mark.
        parts.append(text[found + 2 : found + 3])
        at = found + 3
    parts.append(text[at:])
    return "".join(parts)


def _role(role: str) -> str:
    return escaped(role).replace("\n", _LINE_END)


def _marked(turn: Turn) -> str:
    return f"{_OPEN}{_role(turn.role)}\n{escaped(turn.text)}{_CLOSE}\n"


# The template of the query: each turn between control strings, its role on the first line.
marked_turns = PerTurn(_marked)


def _unused(turns: list[Turn]) -> str:
    """A text of one or more characters of the private use area that no turn holds."""
    texts = [x for t in turns for x in t]
    held = set().union(*map(set, texts)) if texts else set()
    for c in map(chr, range(0xE000, 0xF900)):
        if c not in held:
            return c
    # All of them occur: a run that is longer than any in a turn, and an end that shows where it stands.
    length = 2
    while any("\ue000" * length in x for x in texts):
        length *= 2
    return "\ue000" * length + "\ue001"


def render_incrementally(template: Template, turns: list[Turn]) -> Rendered:
    """The output for all turns, the span of each, and whether a prefix was rendered otherwise later.

    A turn's text is found by rendering its prefix with an unused character in its place; a
    template that doesn't show the text as one piece leaves the span of the text empty. After a
    rewrite, a span starts where the output parts from the one before.
    """
    spans: list[Span] = []
    mark = _unused(turns)
    before, rewrites = template([]), False
    for k, turn in enumerate(turns):
        now = template(turns[: k + 1])
        start = len(before)
        if not now.startswith(before):
            rewrites = True
            start = _common(before, now)
        marked = template([*turns[:k], Turn(turn.role, mark)])
        head, found, tail = marked.partition(mark)
        if found and now.startswith(head) and now.endswith(tail) and len(now) >= len(head) + len(tail):
            spans.append(Span(start, len(now), len(head), len(now) - len(tail)))
        else:
            spans.append(Span(start, len(now), len(now), len(now)))
        before = now
    return Rendered(before, spans, rewrites)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


_FORMATTED = (
    "conv_id long, segment long, offset long, formatted string, rewrites_history boolean, "
    "spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long,in_loss:boolean>>"
)
_SPAN = pa.struct(
    [("role", pa.string())]
    + [(name, pa.int64()) for name in ("start", "end", "text_start", "text_end")]
    + [("in_loss", pa.bool_())]
)
_FIELDS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("segment", pa.int64()),
        ("offset", pa.int64()),
        ("formatted", pa.string()),
        ("rewrites_history", pa.bool_()),
        ("spans", pa.list_(_SPAN)),
    ]
)


def _format(
    batches: Iterable[pa.RecordBatch], template: Template, loss_roles: tuple[str, ...], segment_turns: int | None
) -> Iterator[pa.RecordBatch]:
    """Turns in order as segments, or as whole conversations if segment_turns is None; holds the turns of one."""
    held: list[Turn] = []
    key, segment, offset, out = None, 0, 0, []

    def closed() -> dict:
        rendered = render_incrementally(template, held)
        spans = [
            dict(role=t.role, in_loss=t.role in loss_roles, **s._asdict()) for t, s in zip(held, rendered.spans)
        ]
        return dict(zip(_FIELDS.names, (key[0], segment, offset, rendered.text, rendered.rewrites_history, spans)))

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if key != (conv,) or len(held) == segment_turns:
                if held:
                    out.append(closed())
                    offset += len(out[-1]["formatted"])
                segment, offset = (segment + 1, offset) if key == (conv,) else (0, 0)
                key, held = (conv,), []
            held.append(Turn(role, text))
        if len(out) >= ROWS_OUT:
            yield pa.RecordBatch.from_pylist(out, _FIELDS)
            out = []
    if held:
        out.append(closed())
    if out:
        yield pa.RecordBatch.from_pylist(out, _FIELDS)


def formatted(
    conversations: DataFrame,
    template: Template = marked_turns,
    loss_roles: tuple[str, ...] = ("assistant",),
    segment_turns: int = SEGMENT_TURNS,
) -> DataFrame:
    """(conv_id, segment, offset, formatted, rewrites_history, spans) of rows (conv_id, turn, role, text).

    Turns are in the order of ``turn``, null first; rows that repeat one follow by role and text,
    so repeated rows are repeated turns. A null role or text is an empty one; rows without a
    conv_id are one conversation without an id. An empty table has no rows; other columns don't
    matter. The text of a span with in_loss is what training learns.

    A conversation is one row, segment 0. Only that of a ``PerTurn`` template with more than
    ``segment_turns`` turns is several, consecutive rows of one partition, in order: formatted,
    one after the other, is the conversation's text, and a span counts from the segment, whose
    first code point is number ``offset`` of the conversation.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    most = segment_turns if isinstance(template, PerTurn) else None
    work = partial(_format, template=template, loss_roles=loss_roles, segment_turns=most)
    return ordered.select("conv_id", "role", "text").mapInArrow(work, _FORMATTED)


def read_back(segment: dict) -> Iterator[tuple[str, str, bool]]:
    """(role, text, in_loss) of each turn of an output of ``marked_turns``.

    Roles and texts come from the formatted string alone, the mask from the spans.
    """
    text = segment["formatted"]
    for span in segment["spans"]:
        turn = text[span["start"] : span["end"]]
        if not (turn.startswith(_OPEN) and turn.endswith(f"{_CLOSE}\n")):
            raise ValueError("not an output of this template")
        role, _, body = turn[len(_OPEN) : -len(_CLOSE) - 1].partition("\n")
        masked = text[span["text_start"] : span["text_end"]] if span["in_loss"] else ""
        if span["in_loss"] and masked != body:
            raise ValueError("the mask and the turn differ")
        yield unescaped(role.replace(_LINE_END, "\n")), unescaped(body), span["in_loss"]


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation from its consecutive segments, with the state of one only."""
    key, n, chars, size = None, 0, 0, 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), _DIGEST_TYPES)]
        return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in _DIGESTS.split(", ")])

    for batch in batches:
        for segment in batch.to_pylist():
            if key != (segment["conv_id"],):
                if key:
                    out.append((key[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))
                key, n, chars, size = (segment["conv_id"],), 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            size += len(segment["formatted"])
            for role, text, in_loss in read_back(segment):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
                if in_loss:
                    chars += len(text)
                    loss.update(text.encode())
        if len(out) >= ROWS_OUT:
            yield batch_of(out)
            out = []
    if key:
        out.append((key[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))
    if out:
        yield batch_of(out)


def digests(segments: DataFrame) -> DataFrame:
    """What the outputs of ``formatted`` with ``marked_turns`` say, per conversation."""
    return segments.mapInArrow(_digest, _DIGESTS)

