"""Chat formatting whose texts survive a round trip through the grammar.

Grammar of a formatted conversation: turns, one after the other, with nothing between.

    turn = "[INST] " text " [/INST]"            role user
         | "<s>" text "</s>"                    role assistant
         | "[ROLE=" name "] " text " [/ROLE]"   any other role

A text holds no bare mark. A mark inside a text carries backslashes after its
bracket, one more than in the source (``[INST]`` is written ``[\\INST]``, and
``[\\INST]`` is written ``[\\\\INST]``), so escaping can be undone exactly, and a
text without marks stays as it is. Every turn is rendered, read by the
deterministic parser and compared with its source; where they differ, its
conflicting marks are escaped, until both are the same.

Rendering is a map over rows, before anything is shuffled. Then the turns of a
conversation meet in order in one task, which passes them on as they come: a
conversation is one row of output, or several numbered ones of about
``PIECE_CHARS`` code points each, however many turns it has. The loss mask is
a list of spans of code points of a piece: the texts of the assistant, escapes
included, without their marks.

Nulls and ties: a null text or role is empty; a null conversation is one of its
own; a null turn comes first; equal turns are taken by role, then by rendered
text. Repeated rows all stay. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 1 << 20

PIECES = "conv_id long, piece long, n_turns long, formatted string, loss array<struct<start: long, end: long>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN))])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])

#: Roles with marks of their own: what opens and closes a turn.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
_ROLE_CLOSE = " [/ROLE]"

_CONTROL = regex.compile(r"([\[<])(\\*+)(/?INST\]|/ROLE\]|ROLE=|/?s>)")
_OPENING = regex.compile(r"\[INST\] |<s>|\[ROLE=((?:[^\]\\]|\\.)*+)\] ", regex.DOTALL)


class GrammarError(ValueError):
    """The text is no formatted conversation."""


def parse(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end) of each turn; the span is that of its text, still escaped."""
    at = 0
    while at < len(formatted):
        opening = _OPENING.match(formatted, at)
        if not opening:
            raise GrammarError(f"no turn begins at {at}")
        role = {"[INST] ": "user", "<s>": "assistant"}.get(opening[0])
        close = MARKS[role][1] if role else _ROLE_CLOSE
        if role is None:
            role = regex.sub(r"\\(.)", r"\1", opening[1], flags=regex.DOTALL)
        start = opening.end()
        for mark in _CONTROL.finditer(formatted, start):
            if not mark[2]:
                break
        else:
            raise GrammarError(f"the turn at {at} is not closed")
        end = mark.end() - len(close)
        if end < start or formatted[end : mark.end()] != close:
            raise GrammarError(f"a bare mark stands at {mark.start()}")
        yield role, start, end
        at = mark.end()


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def recovered(formatted: str) -> list[tuple[str, str]] | None:
    """Turns as the parser reads them; None if it cannot."""
    try:
        return [(role, unescape(formatted[start:end])) for role, start, end in parse(formatted)]
    except GrammarError:
        return None


def render(role: str, text: str) -> str:
    """The turn, its text escaped only if that is needed to read it back."""
    opening, close = MARKS.get(role) or (f"[ROLE={regex.sub(r'([]\\])', r'\\\1', role)}] ", _ROLE_CLOSE)
    for body in (text, escape(text)):
        if recovered(turn := opening + body + close) == [(role, text)]:
            return turn
    raise GrammarError(f"a turn of role {role!r} cannot be read back")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, rendered), a row for each turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, role, text = batch.columns
            out = [render(r, t) for r, t in zip(role.to_pylist(), text.to_pylist())]
            yield pa.RecordBatch.from_arrays([conv, turn, role, pa.array(out, pa.string())], names=["conv_id", "turn", "role", "rendered"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, rendered string")


def format_conversations(conversations: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(conv_id, piece, n_turns, formatted, loss): the pieces of a conversation stand in order in one partition."""
    together = turns(conversations).repartition("conv_id")
    ordered = together.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "rendered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for piece in _pieces(batches, piece_chars):
            rows.append(piece)
            size += len(piece[3])
            if size > piece_chars or len(rows) >= 1000:
                yield _batch(rows, _PIECES)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _PIECES)

    return ordered.mapInArrow(run, PIECES)


def _pieces(batches: Iterator[pa.RecordBatch], piece_chars: int) -> Iterator[tuple]:
    """Turns of one conversation joined until they are ``piece_chars`` long."""
    conv, number, parts, spans, size = None, 0, [], [], 0
    for batch in batches:
        for next_conv, _, role, rendered in zip(*(c.to_pylist() for c in batch.columns)):
            if parts and (next_conv != conv or size + len(rendered) > piece_chars):
                yield conv, number, len(parts), "".join(parts), spans
                number = number + 1 if next_conv == conv else 0
                parts, spans, size = [], [], 0
            conv = next_conv
            if role == "assistant":
                opening, close = MARKS[role]
                spans.append({"start": size + len(opening), "end": size + len(rendered) - len(close)})
            parts.append(rendered)
            size += len(rendered)
    if parts:
        yield conv, number, len(parts), "".join(parts), spans


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, from its pieces alone.

    ``pieces`` are clustered and in order as ``format_conversations`` gives them;
    those of a stored table need ``repartition("conv_id").sortWithinPartitions("conv_id", "piece")``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, state = [], None, None
        for batch in batches:
            for next_conv, _, _, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or next_conv != conv:
                    if state:
                        done.append((conv, *state.row()))
                    conv, state = next_conv, _Digest()
                state.add(formatted, loss)
                if len(done) >= 5000:
                    yield _batch(done, _DIGESTS)
                    done = []
        if state:
            done.append((conv, *state.row()))
        if done:
            yield _batch(done, _DIGESTS)

    return pieces.mapInArrow(run, DIGESTS)


class _Digest:
    """Running digests of a conversation."""

    def __init__(self):
        self.turns = self.chars = self.loss_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, start, end in parse(formatted):
            self.all.update(f"{role}\n{unescape(formatted[start:end])}\n".encode())
            self.turns += 1
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for field, values in zip(schema, zip(*rows))], schema=schema)
