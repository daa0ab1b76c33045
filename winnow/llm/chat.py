"""Chat formatting with a grammar round trip.

A conversation is written as ``<s>`` and its turns; a parser that knows only the grammar
reads the text back, and a turn whose parsed form differs from its source is escaped until
both are the same.

    conversation = "<s>" turn*
    turn         = "[INST] " text " [/INST]"            user
                 | " " text "</s>"                      assistant
                 | "[ROLE]" role "[/ROLE]" text "[END]" any other role

The markers are fixed values. An opening bracket stands only at their start, so no text and
marker together can make another marker. Inside a text, a backslash after that bracket marks
an escaped marker: escaping adds one, reading takes one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKERS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[END]")
BEGIN = "<s>"

_RESTS = {"<": "|".join(re.escape(m[1:]) for m in MARKERS if m[0] == "<"),
          "[": "|".join(re.escape(m[1:]) for m in MARKERS if m[0] == "[")}
_CONFLICT = re.compile(rf"(<)(\\*)({_RESTS['<']})|(\[)(\\*)({_RESTS['[']})")
_MARKER = re.compile("|".join(re.escape(m) for m in MARKERS))
_SCHEMA = ("conv_id long, position long, role string, text string, piece string, "
           "loss_start long, loss_end long, parsed_role string, parsed_text string")


def escape(text: str) -> str:
    """One more backslash inside each marker, escaped or not."""
    return _CONFLICT.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    """One backslash less inside each escaped marker; a bare marker stays."""
    return _CONFLICT.sub(
        lambda m: (m[1] or m[4]) + (m[2] or m[5] or "")[1:] + (m[3] or m[6]), text)


def write_turn(role: str, text: str) -> tuple[str, int]:
    """The turn as the grammar has it, and where its text begins in it."""
    if role == "user":
        return f"[INST] {text} [/INST]", 7
    if role == "assistant":
        return f" {text}</s>", 1
    return f"[ROLE]{role}[/ROLE]{text}[END]", 13 + len(role)


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """Roles and texts of a formatted conversation; None if the grammar doesn't fit."""
    if not formatted.startswith(BEGIN):
        return None
    at, turns = len(BEGIN), []

    def until(marker: str, start: int) -> tuple[str, int] | None:
        found = _MARKER.search(formatted, start)
        if found is None or found[0] != marker:
            return None
        return formatted[start:found.start()], found.end()

    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            part = until("[/INST]", at + 7)
            if part is None or not part[0].endswith(" "):
                return None
            turns.append(("user", unescape(part[0][:-1])))
        elif formatted.startswith("[ROLE]", at):
            role = until("[/ROLE]", at + 6)
            part = role and until("[END]", role[1])
            if not part:
                return None
            turns.append((unescape(role[0]), unescape(part[0])))
        elif formatted.startswith(" ", at):
            part = until("</s>", at + 1)
            if part is None:
                return None
            turns.append(("assistant", unescape(part[0])))
        else:
            return None
        at = part[1]
    return turns


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn's piece of the conversation, and the span of its text in that piece.

    Plain first; while the parser reads something else than the source, what conflicts is
    escaped. Escaping is undone by reading, so the second try is the last.
    """
    role, text = role or "", text or ""
    name, body = role, text
    while True:
        piece, start = write_turn(name, body)
        if parse(BEGIN + piece) == [(role, text)]:
            return piece, start, start + len(body)
        if (name, body) == (escape(role), escape(text)):
            raise ValueError("the grammar can't hold this turn")
        name, body = escape(role), escape(text)
        if role in ("user", "assistant"):
            name = role


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation side by side in one partition, in order."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: its piece of the formatted conversation and the loss span in it.

    The formatted conversation is ``<s>`` and the pieces by ``turn`` (ties by role and text).
    Null role or text is empty, null ``conv_id`` is a conversation of its own, repeated rows
    are repeated turns; other columns are ignored. No rows give no rows. ``loss_start`` and
    ``loss_end`` are null for turns other than the assistant's.
    """

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(row["conv_id"], row["turn"], row["role"], *format_turn(row["role"], row["text"]))
                    for row in batch.to_pylist()]
            if rows:
                ids, turn, role, piece, start, end = zip(*rows)
                loss = [r == "assistant" for r in role]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(turn, pa.int64()), pa.array(role, pa.string()),
                    pa.array(piece, pa.string()),
                    pa.array([s if k else None for s, k in zip(start, loss)], pa.int64()),
                    pa.array([e if k else None for e, k in zip(end, loss)], pa.int64()),
                ], ["conv_id", "turn", "role", "piece", "loss_start", "loss_end"])

    return _ordered(conversations).mapInArrow(
        turns, "conv_id long, turn long, role string, piece string, loss_start long, loss_end long")


class _Reader:
    """Digests of one formatted conversation, fed piece by piece."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, len(BEGIN)
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, loss: tuple[int, int] | None) -> None:
        found = parse(BEGIN + piece)
        if found is None:
            raise ValueError("a formatted turn doesn't parse")
        for role, text in found:
            self.all.update(f"{role}\n{text}\n".encode())
        self.turns += len(found)
        self.chars += len(piece)
        if loss:
            text = unescape(piece[loss[0]:loss[1]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame) -> DataFrame:
    """What :func:`format_turns` wrote, parsed again: counts and digests per conversation.

    Turns stream through one digest per conversation, so a conversation of any length takes
    the memory of one turn. Takes the order that :func:`format_turns` leaves.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, done = None, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*done), kinds)], names)
            done.clear()
            return batch

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "piece", "loss_start", "loss_end")]
            for conv_id, piece, start, end in zip(*columns):
                if open_one is None or open_one.conv_id != conv_id:
                    if open_one is not None:
                        done.append(open_one.row())
                    open_one = _Reader(conv_id)
                open_one.feed(piece, None if start is None else (start, end))
            if len(done) >= 1000:
                yield flush()
        if open_one is not None:
            done.append(open_one.row())
        if done:
            yield flush()

    return formatted.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
              "loss_sha256 string, formatted_chars long")
