"""Conversations from logs of events, written out for training.

A log has streamed deltas, edits and regenerations of messages. It is partitioned by conversation and sorted by message and
sequence number, the last event first, and folded in one pass: a message takes its deltas back to the last edit or
regeneration, and events that a later regeneration of this or an earlier message has overtaken are void. Folding by message
gives what folding by sequence number alone gives, but a task then holds one message at a time, however long the conversation.

Final messages are written as turns of one template, in which control strings inside texts are escaped, with a mask over what
the model learns to say. Text, mask and turns are read back from what was written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import OWN, with_row_ids

START, MIDDLE, END = "### ", ": ", "</turn>\n"
#: How the common roles are written; any other stands, escaped, behind OTHER.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
OTHER = "role "
#: Whose texts the mask covers.
LEARNED = "assistant"
#: Code points of a delta when whole texts are replayed as a log.
DELTA = 512
#: Rows and characters of a batch that a worker hands on.
BATCH_ROWS, BATCH_CHARS = 2_048, 1 << 22

DELTA_KIND, EDIT, REGENERATE = "delta", "edit", "regenerate"
_ROLES = {name: role for role, name in NAMES.items()}
_CONTROL = re.compile(r"\\|### |</turn>")
_ROLE_CONTROL = re.compile(r"\\|### |</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^\\:]*+(?:\\.[^\\:]*+)*+): ([^\\<]*+(?:(?:\\.|<(?!/turn>))[^\\<]*+)*+)</turn>\n", re.S)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def written_turn(role: str, text: str) -> tuple[str, int]:
    """(a turn in the template, where its text begins)."""
    head = START + (NAMES.get(role) or OTHER + escape(role, _ROLE_CONTROL)) + MIDDLE
    return head + escape(text) + END, len(head)


def read_turns(written: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that a text begins with; raises where something else follows."""
    at = 0
    while at < len(written):
        m = _TURN.match(written, at)
        if not m:
            raise ValueError(f"not a turn: {written[at : at + 40]!r}")
        yield _ROLES.get(m[1]) or unescape(m[1].removeprefix(OTHER)), unescape(m[2])
        at = m.end()


def log_of(conversations: DataFrame) -> DataFrame:
    """The log that whole turns (conv_id, turn, role, text) would have been streamed as: deltas of at most DELTA code points.

    Each row is a message of its own, also where another has its turn: then they come in the order of the table's files. A null
    text is empty, a null role is the empty one, null turns come first, and null conversations are one. Other columns are
    ignored.
    """
    part = f"{OWN}part"
    rows = with_row_ids(conversations.select(*(F.col(c).cast(k).alias(c) for c, k in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")))), part)
    text = F.coalesce("text", F.lit(""))
    pieces = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)))
    return rows.select("conv_id", F.col("turn").alias("message"), F.col(part).alias("part"), "role", F.posexplode(pieces).alias("seq", "text")).select(
        "conv_id", "message", "part", F.col("seq").cast("long").alias("seq"), F.lit(DELTA_KIND).alias("kind"), "role", "text"
    )


def _arranged(log: DataFrame) -> DataFrame:
    """A log by conversation, message and sequence number, the last event first; part tells messages of one number apart."""
    part = F.col("part") if "part" in log.columns else F.lit(0)
    kind = F.coalesce("kind", F.lit(DELTA_KIND))
    rank = F.when(kind == REGENERATE, 0).when(kind == EDIT, 1).when(kind == DELTA_KIND, 2).otherwise(F.raise_error(F.concat(F.lit("no such kind of event: "), kind)).cast("int"))
    events = log.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("message").cast("long").alias("message"), part.cast("long").alias("part"),
        F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("seq"), rank.alias("rank"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return events.repartition("conv_id").sortWithinPartitions("conv_id", "message", "part", F.desc("seq"), F.desc("rank"), F.desc("text"), F.desc("role"))


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _messages(events: Iterator[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """(conv_id, role, text) of the final messages, from events as _arranged() orders them."""
    for conv, own in groupby(events, lambda e: e[0]):
        since = None  # the last regeneration of an earlier message: what is older is void
        for _, group in groupby(own, lambda e: (e[1], e[2])):
            parts, role, going, again = [], None, True, since
            for _, _, _, seq, rank, said, text in group:
                if since is None or seq >= since:
                    role = said if role is None else role
                    if going:
                        parts.append(text)
                        going = rank == 2  # an edit or a regeneration begins the text anew
                if rank == 0 and (again is None or seq > again):
                    again = seq
            since = again
            if parts:
                yield conv, role or "", "".join(reversed(parts))


def _turns(messages: Iterator[tuple[int | None, str, str]]) -> Iterator[tuple]:
    """(conv_id, place, written, loss_from, loss_to): turns, and the place of what the mask covers in the conversation's text."""
    for conv, own in groupby(messages, lambda m: m[0]):
        at = 0
        for place, (_, role, text) in enumerate(own):
            written, head = written_turn(role, text)
            learned = role == LEARNED
            yield conv, place, written, at + head if learned else None, at + len(written) - len(END) if learned else None
            at += len(written)


def _digests(turns: Iterator[tuple]) -> Iterator[tuple]:
    """Reads written conversations back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    for conv, own in groupby(turns, lambda t: t[0]):
        said, learned = hashlib.sha256(), hashlib.sha256()
        n = chars = at = 0
        for _, _, written, start, stop in own:
            for role, text in read_turns(written):
                said.update(f"{role}\n{text}\n".encode())
                n += 1
            if start is not None:
                masked = unescape(written[start - at : stop - at])
                learned.update(masked.encode())
                chars += len(masked)
            at += len(written)
        yield conv, n, said.hexdigest(), chars, learned.hexdigest(), at


def _batched(rows: Iterator[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    total = 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= BATCH_ROWS or total >= BATCH_CHARS:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


def final_messages(log: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the messages that a log (conv_id, message, seq, kind, role, text) leaves, in their order.

    `delta` adds to a message's text, `edit` replaces it, and `regenerate` replaces it and voids what was said before in all
    later messages; a null kind is `delta`, others raise. A message has the role of its last event that has one and isn't void;
    it is gone when all its events are void. Of events with one number, regenerations come first, then edits, then
    deltas, by message and text. A null text is empty, a null number the lowest. Messages come by `message` and, if there is such a column,
    `part`, nulls first; events of a null conversation belong together. A log without rows gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = ((conv, k, role, text) for conv, own in groupby(_messages(_events(batches)), lambda m: m[0]) for k, (_, role, text) in enumerate(own))
        yield from _batched(placed, ("conv_id", "place", "role", "text"), (pa.int64(), pa.int64(), pa.string(), pa.string()), lambda r: len(r[3]))

    return _arranged(log).mapInArrow(run, "conv_id long, place long, role string, text string")


def formatted(log: DataFrame) -> DataFrame:
    """(conv_id, place, written, loss_from, loss_to): the final messages of a log as turns of the template. A conversation's text
    is its turns one after the other; the mask covers code points loss_from to loss_to of it, for the assistant's texts.
    What counts as final, and nulls, ties and empty logs, are as in final_messages()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield from _batched(_turns(_messages(_events(batches))), ("conv_id", "place", "written", "loss_from", "loss_to"), types, lambda r: len(r[2]))

    return _arranged(log).mapInArrow(run, "conv_id long, place long, written string, loss_from long, loss_to long")


def format_report(log: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation of a log, read back from
    what formatted() writes. A conversation is read as a stream by one task, for its hashes need its turns in order; the task
    holds a turn at a time. Nulls, ties and empty logs are as in final_messages()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        yield from _batched(_digests(_turns(_messages(_events(batches)))), names, types, lambda r: 200)

    return _arranged(log).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
