"""Prefix-target expansion of conversations.

Every assistant turn becomes an example: all turns before it are the context,
and only its own text is under the loss mask. :func:`format_turns` writes each turn as a
piece of the formatted conversation, :func:`expand` makes the examples of those, each with its
context in full, and :func:`read_back` takes texts and masks from the examples again. The examples of
a conversation together take the square of its length. One beyond ``PART`` code points comes in several
rows, cut between turns, so no row is longer than that or a turn; a task holds one conversation.

Template: ``<turn:ROLE>TEXT</turn>`` and a line feed. In roles and texts, backslash, ``<`` and
``>`` are written as ``\\\\``, ``\\l`` and ``\\g``, so no control string can occur in
them, and reading back gives the very same strings.

Defined cases: null role or text is empty; rows come by turn, nulls first, ties by
role and text; repeated rows are turns of their own; a null id is a conversation
like any other. Turns after the last assistant turn are in no example; they come as a row without
a number and a mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credtrail.llm.common import batches

TRAINED_ROLE = "assistant"

#: Code points of an example from which on a new row begins.
PART = 1 << 20

PIECE = re.compile(r"<turn:([^<>]*)>([^<>]*)</turn>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
PLAIN = {"\\": "\\", "l": "<", "g": ">"}

FORMATTED = (
    "conv_id bigint, turn_no bigint, piece string, start bigint, "
    "example_no bigint, target_start bigint, target_end bigint"
)
EXPANDED = (
    "conv_id bigint, example_no bigint, text string, loss_start bigint, loss_end bigint, "
    "start bigint, own_start bigint"
)
READ = (
    "conv_id bigint, example_no bigint, start bigint, end bigint, own string, own_start bigint, "
    "loss_start bigint, loss_end bigint, context_sha256 string, sha256 string"
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint, n_examples bigint"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: PLAIN[m[1]], text) if "\\" in text else text


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn of ``conv_id, turn, role, text``: its piece of the
    formatted conversation, where that starts (in code points), and for
    assistant turns the number of the example and the span under the loss mask."""
    rows = turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format, FORMATTED)


def _format(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        conv, n, at, example = object(), 0, 0, 0
        for part in parts:
            for c, role, text in zip(
                *(part.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True
            ):
                if c != conv:
                    conv, n, at, example = c, 0, 0, 0
                head, body = f"<turn:{escape(role)}>", escape(text)
                piece = f"{head}{body}</turn>\n"
                if role == TRAINED_ROLE:
                    target = (example, at + len(head), at + len(head) + len(body))
                    example += 1
                else:
                    target = (None, None, None)
                yield (c, n, piece, at, *target)
                n, at = n + 1, at + len(piece)

    yield from batches(rows(), _arrow(FORMATTED), lambda r: 64 + len(r[2]))


def expand(formatted: DataFrame) -> DataFrame:
    """The examples in full: text of context and reply, and the span to train on. ``start`` is where
    the text of the row starts and ``own_start`` where that begins which no example before holds, all
    as offsets (in code points) into the conversation."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return rows.mapInArrow(_expand, EXPANDED)


def _expand(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        conv, before = object(), None
        for part in parts:
            for r in part.to_pylist():
                if r["conv_id"] != conv:
                    if before is not None:
                        yield from before.rest(conv)
                    conv, before = r["conv_id"], _Prefix()
                before.add(r["piece"])
                if r["example_no"] is not None:
                    yield from before.example(conv, r["example_no"], r["target_start"], r["target_end"])
        if before is not None:
            yield from before.rest(conv)

    yield from batches(rows(), _arrow(EXPANDED), lambda r: 64 + len(r[2]))


class _Prefix:
    """The conversation up to a turn: texts of ``PART`` code points or a bit more, and the open one."""

    def __init__(self):
        self.full, self.open, self.open_size = [], [], 0
        self.open_start = self.own_start = 0

    def add(self, piece: str) -> None:
        if self.open_size and self.open_size + len(piece) > PART:
            self.full.append((self.open_start, "".join(self.open)))
            self.open_start += self.open_size
            self.open, self.open_size = [], 0
        self.open.append(piece)
        self.open_size += len(piece)

    def texts(self) -> list[tuple[int, str]]:
        self.open = ["".join(self.open)]
        return [*self.full, (self.open_start, self.open[0])]

    def example(self, conv, number, loss_start, loss_end):
        for start, text in self.texts():
            yield conv, number, text, loss_start, loss_end, start, self.own_start
        self.own_start = self.open_start + self.open_size

    def rest(self, conv):
        for start, text in self.texts():
            if start + len(text) > self.own_start:
                cut = max(0, self.own_start - start)
                yield conv, None, text[cut:], None, None, start + cut, self.own_start


def read_back(examples: DataFrame) -> DataFrame:
    """Read examples and masks, one row per conversation. Each example is read where it is: what it
    adds to the one before goes on, with digests of its context and of its whole. In order, the context
    must be the whole of the example before; only running hashes are held."""
    rows = examples.mapInArrow(_read, READ)
    order = ["conv_id", F.col("example_no").asc_nulls_last(), "start"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_digest, DIGESTS)


def digests(formatted: DataFrame) -> DataFrame:
    """What the examples of formatted conversations hold."""
    return read_back(expand(formatted))


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for part in parts:
            for r in part.to_pylist():
                start, text = r["start"], r["text"]
                cut = min(max(0, r["own_start"] - start), len(text))
                own, seen = text[cut:], hashlib.sha256(text[:cut].encode())
                context = seen.hexdigest() if cut else None
                seen.update(own.encode())
                yield (
                    r["conv_id"], r["example_no"], start, start + len(text), own, start + cut,
                    r["loss_start"], r["loss_end"], context, seen.hexdigest(),
                )

    yield from batches(rows(), _arrow(READ), lambda r: 256 + len(r[4]))


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        state = None
        for part in parts:
            for r in part.to_pylist():
                if state is None or state.conv != r["conv_id"]:
                    if state is not None:
                        yield state.totals()
                    state = _Conversation(r["conv_id"])
                state.add(r)
        if state is not None:
            yield state.totals()

    yield from batches(rows(), _arrow(DIGESTS))


class _Conversation:
    """Running hashes of the examples of a conversation, in order."""

    def __init__(self, conv):
        self.conv, self.n_turns, self.loss_chars, self.size, self.n_examples = conv, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        # Digests of the rows of the example before and of this one, by where they start.
        self.example, self.end, self.before, self.here = None, 0, {}, {}

    def add(self, r: dict) -> None:
        number, start, own = r["example_no"], r["start"], r["own"]
        if number is not None and number != self.example:
            self.require(number == self.n_examples and self.end == self.size)
            self.n_examples += 1
            self.example, self.end, self.before, self.here = number, 0, self.here, {}
        self.require(start == self.end and (not own or r["own_start"] == self.size))
        if r["context_sha256"] is not None:
            self.require(self.before.get(start) == r["context_sha256"])
        self.here[start], self.end = r["sha256"], r["end"]
        at = 0
        while at < len(own):
            piece = PIECE.match(own, at)
            self.require(piece is not None)
            role, text = map(unescape, piece.groups())
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
            at = piece.end()
        if number is not None and r["own_start"] <= r["loss_start"] < r["end"]:
            trained = unescape(own[r["loss_start"] - r["own_start"] : r["loss_end"] - r["own_start"]])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())
        self.size += len(own)

    def require(self, true: bool) -> None:
        if not true:
            raise ValueError(f"conversation {self.conv}: the examples do not continue each other")

    def totals(self) -> tuple:
        return (
            self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.size, self.n_examples,
        )


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])
