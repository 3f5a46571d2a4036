"""Conversations as marked-up text with loss flags, by a template and a state machine over roles.

A ``Template`` states the opening of each role, the end of a turn, which roles are learned and
which role may follow which.  Formatting gives one row per turn: its segments, each with a loss
flag, whether its role may stand there, and the state reached.  Turns out of order are formatted
like all others; they are marked, not dropped.

Control strings inside texts are broken up by an escape character behind their first character,
and escape characters are doubled; so no control string is left in an escaped text, and
``read_turn`` gives role and text back.

Rows are exchanged once, by conversation, sorted inside the engine (which spills), and walked as
a stream that holds one batch and one state; so a conversation may be of any length.  A digest of
a whole conversation is one chain of SHA-256 steps by definition and cannot be split.

Order: turn, then role, then text; null turns first.  Null role and null text are empty, and rows
without conversation id are one conversation.  Repeated rows are turns of their own.  An empty
table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """What is written around a turn, and which turns may follow each other."""

    openings: Mapping[str, str]
    #: Opens a turn of any other role, whose name then stands in the text, up to ``named``.
    other: str = "### Role: "
    named: str = "</role>"
    end: str = "</turn>"
    separator: str = "\n"
    learned: frozenset[str] = frozenset({"assistant"})
    #: (state, role) to the next state; the state a conversation may end in.
    moves: Mapping[tuple[str, str], str] = field(default_factory=dict)
    finals: frozenset[str] = frozenset()
    escape: str = "\\"

    def __post_init__(self):
        control = self.control
        if any(len(c) < 2 or self.escape in c for c in control) or len(self.escape) != 1:
            raise ValueError("control strings have two characters or more, none the escape character")
        if any(a != b and (a in b or b.startswith(a)) for a in control for b in control):
            raise ValueError("no control string may hold another one")
        if any(a[i:] and b.startswith(a[i:]) for a in control for b in control for i in range(1, len(a))):
            raise ValueError("no control string may begin with the end of another one")

    @cached_property
    def control(self) -> tuple[str, ...]:
        return (*self.openings.values(), self.other, self.named, self.end)

    @cached_property
    def _to_escape(self) -> re.Pattern:
        parts = [f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.control]
        return re.compile("|".join([re.escape(self.escape), *parts]))

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.escape)}({re.escape(self.escape)}?)")

    @cached_property
    def _opening(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, [*self.openings.values(), self.other])))

    def escaped(self, text: str) -> str:
        return self._to_escape.sub(lambda m: m[0] + self.escape, text)

    def unescaped(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[1], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn as written, cut where the loss flag changes its meaning: opening, text, end."""
        if role in self.openings:
            opening = self.openings[role]
        else:
            opening = self.other + self.escaped(role) + self.named
        return [(opening, False), (self.escaped(text), role in self.learned), (self.end + self.separator, False)]

    def read_turn(self, written: str) -> tuple[str, str]:
        """Role and text of one written turn."""
        tail = self.end + self.separator
        opening = self._opening.match(written)
        if not opening or not written.endswith(tail):
            raise ValueError("not a turn of this template")
        at, stop = opening.end(), len(written) - len(tail)
        if opening[0] == self.other:
            cut = written.index(self.named, at)
            role, at = self.unescaped(written[at:cut]), cut + len(self.named)
        else:
            role = next(r for r, o in self.openings.items() if o == opening[0])
        if self.end in written[at:stop]:
            raise ValueError("more than one turn")
        return role, self.unescaped(written[at:stop])

    def next_state(self, state: str | None, role: str) -> str | None:
        """None once a role stood where it may not: no later turn is in order."""
        return self.moves.get((state, role)) if state else None


CHAT = Template(
    openings={"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    moves={
        (START, "system"): "system",
        (START, "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    finals=frozenset({"user", "assistant"}),
)

_SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])
_TURN = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("state", pa.string()), ("in_order", pa.bool_()),
     ("segments", pa.list_(_SEGMENT))]
)
TURN_DDL = (
    "conv_id bigint, position bigint, state string, in_order boolean, segments array<struct<text: string, loss: boolean>>"
)


def format_turns(conversations: DataFrame, template: Template = CHAT, key: str = "conv_id") -> DataFrame:
    """One row per turn: ``conv_id, position`` (from 0), ``state, in_order, segments`` (text, loss).

    The rows of a conversation lie together and in order in one partition.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, state = None, -1, START
        for batch in batches:
            rows = []
            for own, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position < 0 or own != conv:
                    conv, position, state = own, -1, START
                position += 1
                state = template.next_state(state, role)
                pieces = [{"text": t, "loss": f} for t, f in template.segments(role, text)]
                rows.append({"conv_id": conv, "position": position, "state": state, "in_order": state is not None, "segments": pieces})
            yield pa.RecordBatch.from_pylist(rows, schema=_TURN)

    rows = conversations.select(
        F.col(key).cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(walk, TURN_DDL)


class _Digest:
    """Running digests of one conversation, read from what was written."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.written, self.learned = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.in_order, self.state = True, None

    def add(self, template: Template, segments: list[dict], in_order: bool, state: str | None) -> None:
        written = "".join(s["text"] for s in segments)
        role, text = template.read_turn(written)
        self.all.update(f"{role}\n{text}\n".encode())
        for part in (template.unescaped(s["text"]) for s in segments if s["loss"]):
            self.loss.update(part.encode())
            self.learned += len(part)
        self.turns, self.written = self.turns + 1, self.written + len(written)
        self.in_order, self.state = self.in_order and in_order, state

    def row(self, template: Template) -> dict:
        return {
            "conv_id": self.conv, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(),
            "loss_chars": self.learned, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.written,
            "in_order": self.in_order and self.state in template.finals,
        }


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("in_order", pa.bool_())]
)


def conversation_digests(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation, read back from the segments of ``format_turns``.

    ``turns`` must hold each conversation together and in order, as ``format_turns`` gives them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            for conv, position, state, in_order, segments in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0:
                    if current:
                        done.append(current.row(template))
                    current = _Digest(conv)
                current.add(template, segments, in_order, state)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_DIGEST)
        if current:
            yield pa.RecordBatch.from_pylist([current.row(template)], schema=_DIGEST)

    return turns.mapInArrow(
        read,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, in_order boolean",
    )
