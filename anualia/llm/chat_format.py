"""Conversations rebuilt from event logs, written as training text with a loss mask.

A log has one row for each event of a message: streamed pieces of text
(``delta``), a whole new text (``edit``), or the start of a new answer in place of
the one so far (``regenerate``). Events are range-sorted by conversation, turn,
message and sequence, so that a long conversation spreads over tasks and a task
holds one message at a time. It folds the events into the final message, renders
the message, and joins rendered messages of one conversation to segments: whole
turns, closed when they have ``SEGMENT_CHARS`` characters and where a task's range
ends. A segment is one row of
the written table: the text, and the places of the assistant's words in it, which
are the loss mask. Reading back takes texts and roles from the rendered text
alone, segment after segment in order, with running digests, so a conversation of
any length needs no more memory than a segment.

Template: every turn stands between ``<s>`` and ``</s>``; users' texts between
``[INST]`` and ``[/INST]``, system texts between ``<<SYS>>`` and ``<</SYS>>``,
assistants' texts alone; texts of other roles between ``[ROLE name]`` and
``[/ROLE]``, the name in hexadecimal. In texts a backslash is doubled, and after
the first character of every control string a backslash is put in, so that no
control string is left; taking single backslashes out and halving double ones
gives the text again.

Defined results: a null text is empty; a null role is a role of its own, whose
name in digests is empty; a null conversation id is one conversation, a null turn
comes first; messages of one turn follow each other in the order of the further
message keys; an event of another kind raises; an empty log gives no rows. Extra
columns are ignored, whatever their names are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anualia.scratch import new_path

SEGMENT_CHARS = 1 << 15
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"
DELTAS = 16  # streamed pieces of a message of a table
LEAST_DELTA = 200

# The control strings of the template.
START, END = "<s>", "</s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>"), "assistant": ("", "")}
OTHER_START, OTHER_END = "[ROLE", " [/ROLE]"
CONTROL = (START, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", OTHER_START, "[/ROLE]")
LEARNED = "assistant"

_HIDDEN = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_SHOWN = re.compile(r"\\(\\?)")
_OTHER = re.compile(r"\[ROLE( [0-9a-f]*)?\] ")


def escape(text: str) -> str:
    """The text without control strings."""
    return _HIDDEN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """The text that was escaped."""
    return _SHOWN.sub(r"\1", text)


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """A turn, and where its text stands in it."""
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = f"{OTHER_START}{'' if role is None else ' ' + role.encode().hex()}] ", OTHER_END
    head, inner = START + head, escape(text)
    return head + inner + tail + END, len(head), len(head) + len(inner)


def parse(rendered: str) -> Iterator[tuple[str | None, str]]:
    """Role and text of every turn of a segment."""
    for turn in rendered.split(END)[:-1]:
        turn = turn.removeprefix(START)
        role = next((r for r, (head, _) in MARKS.items() if head and turn.startswith(head)), None)
        if role:
            head, tail = MARKS[role]
        elif found := _OTHER.match(turn):
            role, head, tail = None if found[1] is None else bytes.fromhex(found[1]).decode(), found[0], OTHER_END
        else:
            role, head, tail = LEARNED, "", ""
        yield role, unescape(turn[len(head) : len(turn) - len(tail)])


class Message:
    """One message while its events come in."""

    def __init__(self):
        self.role: str | None = None
        self.parts: list[str] = []

    def fold(self, kind: str, role: str | None, text: str | None) -> None:
        if kind not in (DELTA, EDIT, REGENERATE):
            raise ValueError(f"unknown kind of event: {kind}")
        if kind != DELTA:
            self.parts.clear()
        if role is not None:
            self.role = role
        if text:
            self.parts.append(text)


def table_events(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The log that ends in the messages of a table with one row for each of them.

    Every text is streamed in at most ``DELTAS`` pieces. By a hash of conversation
    and turn, one message in four has half of an answer before it is regenerated,
    and another one a text in capitals before it is edited.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Names as in the log first, so that columns of the same names do not clash.
    said = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text.alias("text")
    ).select("*", F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("message"))
    events = f"""
        CASE pmod(xxhash64(conv_id, turn), 4)
            WHEN 0 THEN array(named_struct('kind', '{DELTA}', 'text', left(text, length(text) DIV 2)), named_struct('kind', '{REGENERATE}', 'text', ''))
            WHEN 1 THEN array(named_struct('kind', '{DELTA}', 'text', upper(text)))
            ELSE array() END"""
    step = f"greatest({LEAST_DELTA}, ceil(length(text) / {DELTAS}))"
    streamed = f"transform(sequence(0, greatest(length(text) - 1, 0) DIV {step}), i -> named_struct('kind', '{DELTA}', 'text', substring(text, cast(i * {step} + 1 AS INT), cast({step} AS INT))))"
    whole = f"CASE WHEN pmod(xxhash64(conv_id, turn), 4) = 1 THEN array(named_struct('kind', '{EDIT}', 'text', text)) ELSE {streamed} END"
    listed = said.select("conv_id", "turn", "role", "tie", "message", F.expr(f"posexplode(concat({events}, {whole})) AS (seq, event)"))
    return listed.select("conv_id", "turn", "role", "tie", "message", "seq", "event.kind", "event.text")


def write_conversations(events: DataFrame, path: str | None = None, order: tuple[str, ...] = ("role", "tie")) -> str:
    """Fold, render and write a log; returns the folder.

    ``events`` has conv_id, turn, message (a number of its own for each message),
    seq, kind, role and text; ``order`` names columns that put messages of one turn in order.
    """
    path = path or new_path(events.sparkSession, "conversations")
    place = ["conv_id", "turn", *order, "message"]
    # As many ranges as the log has parts, so that a range does not grow with the input.
    parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), events.rdd.getNumPartitions())
    # All events of a message have the same place, so they meet in one task.
    dealt = events.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in place])
    ordered = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in place], "seq")
    kind = events.schema["conv_id"].dataType.simpleString()
    loss = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        known = None  # the type of conv_id, as it comes

        segments: list[dict] = []
        now = {"conv": None, "number": None, "turns": [], "loss": [], "size": 0}
        message, counter = Message(), 0

        def close_message() -> None:
            text, start, stop = render(message.role, "".join(message.parts))
            if message.role == LEARNED:
                now["loss"].append({"start": now["size"] + start, "stop": now["size"] + stop})
            now["turns"].append(text)
            now["size"] += len(text)

        def close_segment() -> None:
            nonlocal counter
            if now["turns"]:
                segments.append({"conv_id": now["conv"], "place": (part << 33) + counter, "n_turns": len(now["turns"]), "text": "".join(now["turns"]), "loss": now["loss"]})
                counter += 1
            now.update(turns=[], loss=[], size=0)

        def batch_of() -> pa.RecordBatch:
            schema = pa.schema([("conv_id", known), ("place", pa.int64()), ("n_turns", pa.int32()), ("text", pa.string()), ("loss", loss)])
            out = pa.RecordBatch.from_pylist(segments, schema=schema)
            segments.clear()
            return out

        for batch in batches:
            known = batch.schema.field(0).type
            for conv, number, kind_of, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now["number"]:
                    if now["number"] is not None:
                        close_message()
                        if conv != now["conv"] or now["size"] >= SEGMENT_CHARS:
                            close_segment()
                    message = Message()
                    now.update(conv=conv, number=number)
                message.fold(kind_of, role, text)
            if segments:
                yield batch_of()
        if now["number"] is not None:
            close_message()
            close_segment()
            yield batch_of()

    schema = f"conv_id {kind}, place long, n_turns int, text string, loss array<struct<start: int, stop: int>>"
    ordered.select("conv_id", "message", "kind", "role", "text").mapInArrow(rendered, schema).write.parquet(path)
    return path


class Digest:
    """Running figures of one conversation."""

    def __init__(self):
        self.turns, self.n_turns = hashlib.sha256(), 0
        self.loss, self.loss_chars, self.chars = hashlib.sha256(), 0, 0

    def add(self, text: str, loss: list[dict]) -> None:
        for role, said in parse(text):
            self.turns.update(f"{role or ''}\n{said}\n".encode())
            self.n_turns += 1
        for span in loss:
            said = unescape(text[span["start"] : span["stop"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation of a written table: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    segments = spark.read.parquet(path).select("conv_id", "place", "text", "loss")
    kind = segments.schema["conv_id"].dataType.simpleString()
    ordered = segments.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, known, done = None, None, None, []

        def batch_of() -> pa.RecordBatch:
            types = [known, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
            done.clear()
            return out

        for batch in batches:
            known = batch.schema.field(0).type
            convs, texts, losses = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for conv, text, loss in zip(convs, texts, losses):
                if digest is None or conv != now:
                    if digest:
                        done.append((now, *digest.row()))
                    now, digest = conv, Digest()
                digest.add(text, loss)
            if done:
                yield batch_of()
        if digest:
            done.append((now, *digest.row()))
            yield batch_of()

    return ordered.mapInArrow(digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
