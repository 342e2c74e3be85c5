r"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names, for each role, the text before and after its turn and whether its text is
trained on. The machine validates the order of turns (system first, then user and assistant in
alternation) and emits one segment for each piece of output: control text and turn text apart,
each with its loss flag.

Control strings inside a text are escaped by putting U+241B after their first character, and a
U+241B of the text is doubled; so the output's control strings are the template's alone and the
texts come back exactly.

Rows are shuffled by conversation and sorted by turn; a conversation streams through its task one
row at a time, so its length is bounded by nothing but the disk.

Defined results: null text counts as empty, a null role as the empty role; an unknown role or an
order that the machine does not accept is formatted all the same and marked ``valid`` false;
equal turns are ordered by role, then text; a null conv_id is a conversation of its own, null
turns come first; empty texts give empty segments; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """What stands around a turn of each role, and which role may follow which."""

    turns: dict[str, Turn]
    other: Turn
    control: tuple[str, ...]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    pattern: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        strings = "|".join(re.escape(c) for c in sorted(self.control, key=len, reverse=True))
        object.__setattr__(self, "pattern", re.compile(f"{ESCAPE}|{strings}"))

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(f"{ESCAPE}{{1,2}}", lambda m: ESCAPE if len(m[0]) == 2 else "", text) if ESCAPE in text else text


#: The role names stand in the control text, so that the output says who spoke.
INST = Template(
    turns={
        "system": Turn("[SYS]", "[/SYS]\n"),
        "user": Turn("<s>[INST]", "[/INST]"),
        "assistant": Turn("[OUT]", "</s>", loss=True),
    },
    other=Turn("[ROLE]", "[/ROLE]"),
    control=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]", "[NAME]"),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)

SEGMENTS = "conv_id long, seq long, text string, loss boolean, valid boolean"


def format_chat(conversations: DataFrame, template: Template = INST) -> DataFrame:
    """Segments in order: conv_id, seq (from 0), text, loss, valid (the order so far is accepted;
    of the last segment: the whole conversation is). Partitioned by conversation and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, seq, ok, begun = None, "", 0, True, False
        held: list[tuple] = []

        def close() -> None:
            if held:
                c, s, t, loss, valid = held.pop()
                held.append((c, s, t, loss, valid and state in template.ends))

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or conv != now:
                    close()
                    now, state, seq, ok, begun = conv, "", 0, True, True
                if len(held) > 512:
                    yield _segments(held[:-1])
                    del held[:-1]
                ok = ok and role in template.follows.get(state, ())
                state = role
                turn = template.turns.get(role)
                before = turn.before if turn else template.other.before + template.escape(role) + "[NAME]"
                turn = turn or template.other
                for piece, loss in ((before, False), (template.escape(text), turn.loss), (turn.after, False)):
                    held.append((now, seq, piece, loss, ok))
                    seq += 1
        close()
        if held:
            yield _segments(held)

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "turn"
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "seq", "text", "loss", "valid"])


class _Reader:
    """Reads a conversation's output back: control strings give the roles, the rest the texts."""

    def __init__(self, conv_id: int | None, template: Template):
        self.conv_id, self.template = conv_id, template
        self.turns, self.all, self.loss = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.opens = {t.before: r for r, t in template.turns.items()}
        self.closes = {t.after for t in (*template.turns.values(), template.other)}
        self.role, self.text, self.valid = None, "", True

    def take(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid = valid
        if loss:
            own = self.template.unescape(text)
            self.loss_chars += len(own)
            self.loss.update(own.encode())
        if self.role is None:
            self.role = self.opens[text] if text in self.opens else self.template.unescape(text.removeprefix(self.template.other.before).removesuffix("[NAME]"))
        elif text in self.closes and self.text is not None:
            self.turns.update(f"{self.role}\n{self.text}\n".encode())
            self.n_turns += 1
            self.role, self.text = None, None
        else:
            self.text = self.template.unescape(text)

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def read_chat(segments: DataFrame, template: Template = INST) -> DataFrame:
    """What the output of format_chat says, one row per conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = None, []
        for batch in batches:
            for conv, _, text, loss, valid in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if reader is None or reader.conv_id != conv:
                    if reader:
                        rows.append(reader.row())
                    reader = _Reader(conv, template)
                reader.take(text, loss, valid)
            if len(rows) > 4096:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows = []
        if reader:
            rows.append(reader.row())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
