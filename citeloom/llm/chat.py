"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine checks the order of turns; the template turns each turn into segments of
text, each with a flag that says whether the loss counts it. Control strings inside
texts are escaped so that a reader gets the turns back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import batches_of, rows_of

# A control string starts with "<|"; a text's own "<|" gets a backslash inside, and one
# that has backslashes there already gets one more.
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


@dataclass(frozen=True)
class ChatTemplate:
    turn_start: str = "<|im_start|>"
    after_role: str = "\n"
    turn_end: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    # state -> role -> next state; a role that is not listed breaks the order.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        if not (self.turn_start.startswith("<|") and self.turn_end.startswith("<|")) or "\n" != self.after_role:
            raise ValueError("control strings start with '<|', and a line break ends the role")


def escape_text(text: str) -> str:
    return _OPENING.sub(r"<\\\1|", text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape_text(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_text(role))


SEGMENTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn_no", pa.int64()),
        ("seg_no", pa.int32()),
        ("text", pa.string()),
        ("loss", pa.bool_()),
        ("in_order", pa.bool_()),
        ("state", pa.string()),
    ]
)
SEGMENTS_DDL = "conv_id bigint, turn_no bigint, seg_no int, text string, loss boolean, in_order boolean, state string"


def turn_segments(turns: Iterator[tuple], template: ChatTemplate) -> Iterator[tuple]:
    """Segments of (conv_id, role, text) rows that come conversation by conversation."""
    conv, state, number, begun = None, template.start, 0, False
    for conv_id, role, text in turns:
        if not begun or conv_id != conv:
            conv, state, number, begun = conv_id, template.start, 0, True
        role, text = role or "", text or ""
        state = template.moves.get(state, {}).get(role, "broken")
        tail = (state != "broken", state)
        yield (conv_id, number, 0, template.turn_start + escape_role(role) + template.after_role, False, *tail)
        yield (conv_id, number, 1, escape_text(text), role in template.loss_roles, *tail)
        yield (conv_id, number, 2, template.turn_end + template.after_turn, False, *tail)
        number += 1


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Segments of all conversations: conv_id, turn_no, seg_no, text, loss, in_order, state.

    Rows of a conversation are taken by turn; ties by role, then text; null turns first.
    A null text or role counts as empty; rows without conv_id make one conversation.
    Every row is formatted. ``in_order`` turns false at the first turn that breaks the
    order and stays false; ``state`` is the machine's state after the turn. An empty
    table gives no segments; other columns are not read.

    Segments come out sorted inside a partition that holds whole conversations; they are
    streamed, so a conversation's length does not matter for memory.
    """
    template = template or ChatTemplate()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = rows_of(batches, "conv_id", "role", "text")
        yield from batches_of(turn_segments(turns, template), SEGMENTS, weight=lambda r: len(r[3]))

    return (
        turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(segments, SEGMENTS_DDL)
    )


class TurnReader:
    """Gets turns back from formatted text, whatever pieces it comes in."""

    def __init__(self, template: ChatTemplate):
        self.template, self.text, self.mask = template, "", []

    def feed(self, text: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the loss mask) of each turn that is complete now."""
        if loss:
            self.mask.append((len(self.text), len(self.text) + len(text)))
        self.text += text
        end = self.template.turn_end + self.template.after_turn
        while (at := self.text.find(end)) >= 0:
            body = self.text[:at]
            if not body.startswith(self.template.turn_start):
                raise ValueError("not formatted by this template")
            role, _, said = body[len(self.template.turn_start) :].partition(self.template.after_role)
            marked = "".join(self.text[a:b] for a, b in self.mask if b <= at)
            self.mask = [(a - at - len(end), b - at - len(end)) for a, b in self.mask if b > at]
            self.text = self.text[at + len(end) :]
            yield unescape_role(role), unescape_text(said), unescape_text(marked)


SUMMARY = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("in_order", pa.bool_()),
        ("complete", pa.bool_()),
    ]
)
SUMMARY_DDL = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, in_order boolean, complete boolean"
)


def read_back(rows: Iterator[tuple], template: ChatTemplate) -> Iterator[tuple]:
    """One summary per conversation of sorted (conv_id, text, loss, in_order, state) rows."""
    begun, conv, last = False, None, ("", False)

    def closed() -> tuple:
        return (conv, turns, spoken.hexdigest(), chars, under.hexdigest(), length, last[1], last[0] in template.accepting)

    for conv_id, text, loss, in_order, state in rows:
        if not begun or conv_id != conv:
            if begun:
                yield closed()
            begun, conv = True, conv_id
            reader, turns, chars, length = TurnReader(template), 0, 0, 0
            spoken, under = hashlib.sha256(), hashlib.sha256()
        length, last = length + len(text), (state, in_order)
        for role, said, marked in reader.feed(text, loss):
            turns, chars = turns + 1, chars + len(marked)
            spoken.update(f"{role}\n{said}\n".encode())
            under.update(marked.encode())
    if begun:
        yield closed()


def conversation_digests(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Summary per conversation, read back from the segments as ``format_conversations``
    gives them. ``complete``: the machine ended in an accepting state."""
    template = template or ChatTemplate()

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, "conv_id", "text", "loss", "in_order", "state")
        yield from batches_of(read_back(rows, template), SUMMARY)

    return segments.mapInArrow(summaries, SUMMARY_DDL)
