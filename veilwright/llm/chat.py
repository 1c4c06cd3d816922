"""Chat formatting from event logs.

An event log holds, by conversation and sequence number, whole messages, streamed deltas, edits and regenerations. Events are
partitioned by the message they change, sorted by sequence and folded in one pass with the state of a single message, so a
conversation with most of the rows is folded by many tasks. Final messages are rendered one row each: the marked turn,
control strings inside texts escaped, and where the loss mask lies. A rendered conversation is its rows in order.

Reading back takes a conversation's rows in order and digests them as they stream by; a task holds one row at a time. A
digest over a whole conversation is sequential by nature: one conversation with a third of all rows is read by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import scratch_path
from .common import arrays, column, partitions

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
EVENTS = ("message", "delta", "edit", "regenerate", "delete")
CHUNK = 2000


@dataclass(frozen=True)
class Template:
    """Turns as ``open role \\n text close \\n``; texts of ``trained`` roles are under the loss mask."""

    open: str = OPEN
    close: str = CLOSE
    trained: tuple[str, ...] = ("assistant",)

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """The rendered turn and the span of its text."""
        head = f"{self.open}{escape(role, True)}\n"
        body = escape(text)
        return f"{head}{body}{self.close}\n", len(head), len(head) + len(body)

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of a rendered turn."""
        if not (turn.startswith(self.open) and turn.endswith(f"{self.close}\n")):
            raise ValueError("not a rendered turn")
        role, _, text = turn[len(self.open):-len(self.close) - 1].partition("\n")
        return unescape(role), unescape(text)


def escape(text: str, line: bool = False) -> str:
    """No control string ``<|`` is left in the result (nor, with ``line``, a line break); ``unescape`` undoes it."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


MESSAGE = "conv_id long, seq long, role string, text string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events sorted by (conv_id, target, message, seq, step) to final messages; the state is one message."""
    out: list[tuple] = []
    key, state = None, None  # state: [conv_id, place, role, parts] or None when nothing is there

    def flush():
        if state is not None:
            out.append((state[0], state[1], state[2], "".join(state[3])))

    for batch in batches:
        for conv, target, message, seq, kind, role, text in arrays(batch, "conv_id", "target", "message", "seq", "kind", "role", "text"):
            if (conv, target, message) != key:
                flush()
                key, state = (conv, target, message), None
            text = text or ""
            if kind == "message":
                flush()
                state = [conv, seq if target is None else target, role or "", [text]]
            elif kind == "delete":
                state = None
            else:
                if state is None:
                    state = [conv, seq if target is None else target, role or "", []]
                if kind == "delta":
                    state[3].append(text)
                else:  # edit and regenerate start the text anew
                    state[3] = [text]
            if len(out) >= CHUNK:
                yield _messages(out)
                out.clear()
    flush()
    yield _messages(out)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      ["conv_id", "seq", "role", "text"])


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of events (conv_id, seq, kind, target, role, text).

    ``target`` is the place of the message an event changes (NULL: its own seq). A message starts anew and keeps what was there;
    a delta appends; an edit or a regeneration replaces the text (NULL: empty); a delete removes the message; an unknown
    or NULL kind counts as a message. Events with equal keys are taken in the order of kind, role and text, messages first.

    Optional columns: ``message`` tells messages of one place apart, ``step`` orders events of one seq.
    """
    place = F.coalesce(F.col("target"), F.col("seq")).cast("long")
    kind = F.when(F.col("kind").isin(*EVENTS[1:]), F.col("kind")).otherwise(F.lit("message"))
    e = events.select(F.col("conv_id").cast("long").alias("conv_id"), place.alias("target"),
                      F.col("seq").cast("long").alias("seq"), kind.alias("kind"), F.col("role").cast("string").alias("role"),
                      F.col("text").cast("string").alias("text"),
                      *[(F.col(c) if c in events.columns else F.lit(None)).cast("long").alias(c) for c in ("message", "step")])
    order = ["conv_id", "target", "message", "seq", "step", F.col("kind") != "message", "kind", "role", "text"]
    return e.repartition(partitions(events.sparkSession), "conv_id", "target", "message").sortWithinPartitions(*order) \
        .mapInArrow(_fold, MESSAGE)


RENDERED = "conv_id long, seq long, role string, rendered string, masked boolean, mask_start int, mask_end int"


def _render(template: Template):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [template.turn(role or "", text or "") for role, text in arrays(batch, "role", "text")]
            roles = column(batch, "role")
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("conv_id")), batch.column(batch.schema.get_field_index("seq")),
                 pa.array(roles, pa.string()), pa.array([t[0] for t in turns], pa.string()),
                 pa.array([r in template.trained for r in roles], pa.bool_()),
                 pa.array([t[1] for t in turns], pa.int32()), pa.array([t[2] for t in turns], pa.int32())],
                [x.split()[0] for x in RENDERED.split(", ")])
    return job


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    return messages.select("conv_id", "seq", "role", "text").mapInArrow(_render(template), RENDERED)


def _read(template: Template):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        key, n, chars, loss, turns_sum, loss_sum = none, 0, 0, 0, None, None
        out: list[tuple] = []
        for batch in batches:
            for conv, turn, masked, a, b in arrays(batch, "conv_id", "rendered", "masked", "mask_start", "mask_end"):
                if conv != key:
                    if key is not none:
                        out.append((key, n, turns_sum.hexdigest(), loss, loss_sum.hexdigest(), chars))
                    key, n, chars, loss, turns_sum, loss_sum = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = template.parse(turn)
                n += 1
                chars += len(turn)
                turns_sum.update(f"{role}\n{text}\n".encode())
                if masked:
                    kept = unescape(turn[a:b])
                    loss += len(kept)
                    loss_sum.update(kept.encode())
            if len(out) >= CHUNK:
                yield _digests(out)
                out.clear()
        if key is not none:
            out.append((key, n, turns_sum.hexdigest(), loss, loss_sum.hexdigest(), chars))
        yield _digests(out)
    return job


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      [x.split()[0] for x in DIGEST.split(", ")])


def read_back(rendered: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of the rendered conversations: turns, text under the loss mask, and characters."""
    order = ["conv_id", "seq", "role", "rendered"]
    return rendered.select("conv_id", "seq", "role", "rendered", "masked", "mask_start", "mask_end") \
        .repartition(partitions(rendered.sparkSession), "conv_id").sortWithinPartitions(*order) \
        .mapInArrow(_read(template), DIGEST)


DELTA = 400


def as_events(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """A plain table (conv_id, turn, role, text) as the log of a chat server that streams: every text arrives in deltas of ``delta``
    characters. Every third message begins with a draft that a regeneration drops, every third short one is sent with a mistake
    and then edited. Folded, each row is its message again.

    Messages are told apart by a number of their own, so rows that repeat stay apart.
    """
    row = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"),
                               F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
                               F.monotonically_increasing_id().alias("message"))
    style = F.pmod(F.xxhash64("conv_id", "seq", "role", "t"), F.lit(3))
    pieces = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))

    def event(kind: str, text) -> object:
        return F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))

    def deltas(parts) -> object:
        return F.transform(parts, lambda x: event("delta", x))

    first, rest = F.coalesce(F.get("p", F.lit(0)), F.lit("")), F.expr("slice(p, 2, greatest(size(p) - 1, 0))")
    streamed = F.concat(F.array(event("message", F.lit(""))), deltas(F.col("p")))
    again = F.concat(F.array(event("message", F.substring("t", 1, 40)), event("delta", F.lit(" ... no")), event("regenerate", first)),
                     deltas(rest))
    edited = F.array(event("message", F.concat(F.lit("?"), F.col("t"))), event("edit", F.col("t")))
    events = F.when(F.col("style") == 0, again).when((F.col("style") == 1) & (F.size("p") <= 1), edited).otherwise(streamed)
    log = row.withColumns({"style": style, "p": pieces}).select(
        "conv_id", "seq", "role", "message", F.posexplode(events).alias("step", "e"))
    return log.select("conv_id", "seq", F.col("e.kind").alias("kind"), F.lit(None).cast("long").alias("target"), "role",
                      F.col("e.text").alias("text"), "message", "step")


def format_chats(events: DataFrame, template: Template = Template()) -> DataFrame:
    """Fold, render, write to the shared folder, read back and digest.

    A NULL text is empty and a NULL role is the empty role; rows without conv_id form one conversation; a NULL turn comes
    first; rows with equal turns are all kept, by role and text. An empty table gives an empty result.
    """
    spark: SparkSession = events.sparkSession
    path = scratch_path(spark, "chats")
    render(fold(events), template).write.parquet(path)
    return read_back(spark.read.schema(RENDERED).parquet(path), template)
