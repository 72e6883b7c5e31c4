"""Repair of damaged conversations by the cheapest edits, with a checkpointed dynamic program.

A repaired conversation has the role initials ``(s?(ua)+)?``. Each row is kept
(0), given the role user or assistant (2) or deleted (3; blank and repeated rows
must be), and empty turns can be inserted anywhere (2); a truncated row that
stays adds 1. Of the cheapest edits those are taken whose initials D, I, K, R
are least in ASCII order.

The program has four states: nothing yet, after system, after user, after
assistant. The role of an inserted or changed turn follows from the state, so
the initials say everything. What is left to pay is computed backwards, and a
vector of it is kept only at every ~sqrt(n)-th row; walking forward, the vectors
of one block are computed again from the checkpoint behind it, and the least
letter that loses nothing is emitted. A row is a byte there, its text is not
needed.

Two passes over the rows, both streams in the order of turns. The first sees
only a digest of each text: repeats are marked by a window over (conversation,
role, digest), then the edits of each conversation are found. In the second the
edits come in front of the rows of their conversation, so each row is edited as
it passes; no text is held. A task holds a byte a row of one conversation and its
edits, and texts a batch at a time.

Nulls and ties: a null role or text is one space; a null conversation is one of
its own; an empty role has no initial and cannot be kept; a null turn comes first; equal turns are taken by role, then by digest
of the text. A row that repeats an earlier role and text is a duplicate, be it
from another turn or the same. A conversation with no rows left has zeros and no
edits. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States are 0 nothing yet, 1 after system, 2 after user, 3 after assistant; a conversation may end in 0 or 3.
_NEXT = (2, 2, 3, 2)  # state after the user or assistant turn that may come next
_NAMES = {2: "user", 3: "assistant"}
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_INF = 1 << 60

#: A row as a byte: its role's initial, and 4 if it is truncated, 8 if it must go.
_INITIALS = ("", "s", "u", "a")
CUT, GONE = 4, 8

_BLANK = " \t\n\x0b\f\r"

AUDITS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
_AUDITS = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
REPAIRED = "conv_id long, place long, role string, text string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
REPORT = f"{AUDITS}, repaired_sha256 string"
_REPORT = _AUDITS.append(pa.field("repaired_sha256", pa.string()))


def _before(row: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost from each state, given the least costs behind the row."""
    costs = []
    kept = _KEPT.get(_INITIALS[row & 3])
    extra = TRUNCATED if row & CUT else 0
    for state in range(4):
        best = DELETE + after[state]
        if not row & GONE:
            best = min(best, RENAME + extra + after[_NEXT[state]])
            if kept and kept[state] is not None:
                best = min(best, extra + after[kept[state]])
        costs.append(best)
    return _inserted(costs)


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """The same with turns inserted first; from any state the second insertion comes back to a state met before."""
    for _ in range(2):
        costs = [min(costs[s], INSERT + costs[_NEXT[s]]) for s in range(4)]
    return tuple(costs)


_END = _inserted([0, _INF, _INF, 0])


class _Steps(dict):
    """``_before`` for vectors that were met: less their least cost there are few."""

    def __missing__(self, key):
        self[key] = value = _before(*key)
        return value


_steps = _Steps()


def _step(row: int, after: tuple[int, ...]) -> tuple[int, ...]:
    least = min(after)
    costs = _steps[row, tuple(c - least for c in after)]
    return tuple(c + least for c in costs)


def cheapest_edits(rows: bytes) -> tuple[int, str]:
    """(cost, initials of the edits) for the rows of a conversation, a byte each."""
    n = len(rows)
    block = max(1, math.isqrt(n))
    checkpoints = {n: _END}  # costs before row k * block, and at the end
    costs = _END
    for i in range(n - 1, -1, -1):
        costs = _step(rows[i], costs)
        if i % block == 0:
            checkpoints[i] = costs
    total, state, audit = costs[0], 0, bytearray()
    for first in range(0, n, block):
        end = min(first + block, n)
        inside = [checkpoints[end]]
        for i in range(end - 1, first - 1, -1):
            inside.append(_step(rows[i], inside[-1]))
        for i in range(first, end):
            here, after, row = inside[end - i], inside[end - i - 1], rows[i]
            kept = _KEPT.get(_INITIALS[row & 3])
            extra = TRUNCATED if row & CUT else 0
            while True:
                if DELETE + after[state] == here[state]:
                    audit += b"D"
                elif INSERT + here[_NEXT[state]] == here[state]:
                    audit += b"I"
                    state = _NEXT[state]
                    continue
                elif kept and not row & GONE and kept[state] is not None and extra + after[kept[state]] == here[state]:
                    audit += b"K"
                    state = kept[state]
                else:
                    audit += b"R"
                    state = _NEXT[state]
                break
    while _END[state]:
        audit += b"I"
        state = _NEXT[state]
    return total, audit.decode()


def _plain(rows: DataFrame, alive: str | None) -> DataFrame:
    """(conv_id, turn, role, text, alive, digest) in the types used here."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.col(alive) if alive else F.lit(True)).alias("alive"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _kind() -> Column:
    """The row as a byte, but for repeats."""
    ends = F.rtrim("text", F.lit(_BLANK))
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    fault = F.when(ends == "", GONE).when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    return code + fault


def audits(rows: DataFrame, alive: str | None = None) -> DataFrame:
    """Faults, cost and edits of each conversation.

    ``alive`` names a column that is false in rows which only name their conversation.
    """
    light = _plain(rows, alive).select("conv_id", "turn", "role", "digest", "alive", _kind().alias("kind")).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "alive", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    marked = light.withColumn("again", F.row_number().over(seen) > 1)
    ordered = marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_conversations(batches), _AUDITS)

    return ordered.select("conv_id", "turn", "alive", "kind", "again").mapInArrow(run, AUDITS)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    conv, state = None, None
    for batch in batches:
        for next_conv, turn, alive, kind, again in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or next_conv != conv:
                if state:
                    yield (conv, *state.row())
                conv, state = next_conv, _Faults()
            if alive:
                state.add(turn, kind, again)
    if state:
        yield (conv, *state.row())


class _Faults:
    """Counts over the rows of a conversation, in order."""

    def __init__(self):
        self.rows, self.first, self.last = bytearray(), None, None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, kind: int, again: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if kind & GONE:
            self.blank += 1
        elif again:
            self.duplicate += 1
            kind = kind & 3 | GONE
        elif kind & CUT:
            self.truncated += 1
        if self.rows:
            self.illegal += (self.rows[-1] & 3, kind & 3) not in ((1, 2), (2, 3), (3, 2))
        self.rows.append(kind)

    def row(self) -> tuple:
        cost, audit = cheapest_edits(bytes(self.rows))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str | None, str | None]]:
    """(audit row, role, text) of each repaired row, after (audit row, None, None) for each conversation."""
    head, edits, state = None, iter(()), 0

    def filled() -> Iterator[tuple]:
        """Turns inserted here; returns the other edit behind them."""
        nonlocal state
        for edit in edits:
            if edit != "I":
                return edit
            state = _NEXT[state]
            yield head, _NAMES[state], ""
        return None

    for batch in batches:
        *about, roles, texts = (c.to_pylist() for c in batch.columns)
        for i, audit in enumerate(about[-1]):
            if audit is not None:
                yield from filled()
                head, edits, state = tuple(c[i] for c in about), iter(audit), 0
                yield head, None, None
                continue
            role, edit = roles[i], (yield from filled())
            if edit == "R":
                state = _NEXT[state]
                role = _NAMES[state]
            elif edit == "K":
                state = _KEPT[role[0]][state]
            if edit != "D":
                yield head, role, texts[i]
    yield from filled()


def _merged(rows: DataFrame, alive: str | None) -> DataFrame:
    """The edits of each conversation, then its rows in order, in one partition."""
    found = audits(rows, alive)
    own = _plain(rows, alive).where("alive").select("conv_id", "turn", "role", "text", "digest")
    together = found.unionByName(own, allowMissingColumns=True).repartition("conv_id")
    ordered = together.sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "digest")
    return ordered.select(*found.columns, "role", "text")


def repaired(rows: DataFrame, alive: str | None = None) -> DataFrame:
    """(conv_id, place, role, text): the rows of each repaired conversation, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered():
            place = 0
            for head, role, text in _edited(batches):
                if role is None:
                    place = 0
                else:
                    yield head[0], place, role, text
                    place += 1

        yield from _batches(numbered(), _REPAIRED)

    return _merged(rows, alive).mapInArrow(run, REPAIRED)


def repair_report(rows: DataFrame, alive: str | None = None) -> DataFrame:
    """``audits`` and the digest of each repaired conversation (``role:text``, joined by line ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reports():
            last, digest, joint = None, None, b""
            for head, role, text in _edited(batches):
                if role is None:
                    if last:
                        yield (*last, digest.hexdigest())
                    last, digest, joint = head, hashlib.sha256(), b""
                else:
                    digest.update(joint + f"{role}:{text}".encode())
                    joint = b"\n"
            if last:
                yield (*last, digest.hexdigest())

        yield from _batches(reports(), _REPORT)

    return _merged(rows, alive).mapInArrow(run, REPORT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of ``conv_id:turn``; dropped ones stay as rows that are not ``alive``."""
    place = [F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat(place[0], F.lit(":"), place[1]).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fate") != 0).alias("alive"), copies.alias("_copy")).drop("_copy")


def _batches(rows: Iterator[tuple], schema: pa.Schema, count: int = 2000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, count)):
        yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for field, values in zip(schema, zip(*part))], schema=schema)
