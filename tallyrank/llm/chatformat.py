"""Conversations as one marked-up text, checked by reading it back.

Template. A turn is ``<|im_start|>`` role, line feed, text, ``<|im_end|>``, line feed. A
deterministic parser reads such text back: it goes from mark to mark, has no rule for another
``<|`` between them, and takes one backslash out of every ``<\\…|`` it meets, in roles and texts alike, and out of ``<\\…n|``, which stands
for a line feed in a role.

Round trip. Turns are rendered as they are, parsed, and compared with their source. A turn
that does not come back (its content holds marks, or something that looks like an escape) is
rendered again with a backslash put into every ``<|`` and escape look-alike; this goes on
until all turns come back. Content without conflict is never touched.

Scale. Conversations are dealt by id and sorted by turn; a task reads them as a stream and
holds at most ``BLOCK`` characters of one conversation, then gives a block: blocks of a
conversation, put together, are its text, and no turn is cut. So a conversation of any
length passes, though by one task, as order demands.

Defined cases. Null text and null role are empty. Turns with equal numbers stand in order of
role, then text; turns without a number come first. Rows without a conversation id form one
conversation with a null id. Repeated rows are turns of their own. Only the four columns are
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import arrays

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Characters of source text after which a block of a conversation is given.
BLOCK = 1 << 20
_CONFLICT = re.compile(r"<(\\*)(n?)\|")
_ESCAPED = re.compile(r"<\\(\\*)(n?)\|")

Turn = tuple[str, str]


def escape(content: str) -> str:
    return _CONFLICT.sub(r"<\\\1\2|", content)


def unescape(content: str) -> str:
    return _ESCAPED.sub(r"<\1\2|", content)


def render(role: str, text: str, escaped: bool = False) -> str:
    if escaped:
        role, text = escape(role).replace("\n", "<n|"), escape(text)
    return f"{START}{role}\n{text}{END}\n"


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the place of the (escaped) text of each turn; stops at what is no turn.

    Inside roles and texts ``<|`` is no part of the grammar.
    """
    at = 0
    while formatted.startswith(START, at):
        head = at + len(START)
        line, end = formatted.find("\n", head), formatted.find("<|", head)
        if not 0 <= line < end or not formatted.startswith(END + "\n", end):
            return
        role = unescape(formatted[head:line].replace("<n|", "\n"))
        yield role, unescape(formatted[line + 1:end]), line + 1, end
        at = end + len(END) + 1


def round_trip(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """Text that parses to just these turns, and where the assistant's texts stand in it."""
    escaped = [False] * len(turns)
    while True:
        parts = [render(*turn, e) for turn, e in zip(turns, escaped)]
        formatted = "".join(parts)
        read = list(parse(formatted))
        if [r[:2] for r in read] == turns:
            return formatted, [r[2:] for r in read if r[0] == ASSISTANT]
        failed = [i for i, (turn, part) in enumerate(zip(turns, parts)) if [r[:2] for r in parse(part)] != [turn]]
        failed = [i for i in failed if not escaped[i]] or [i for i, e in enumerate(escaped) if not e]
        if not failed:
            raise ValueError("escaped turns do not come back")
        for i in failed:
            escaped[i] = True


def formatted(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *,
    block: int = BLOCK,
) -> DataFrame:
    """(conv_id, block, formatted, loss_spans): blocks in order within each partition.

    ``loss_spans`` are (start, end) of the assistant's texts in their block's text.
    """
    rows = df.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, number, held, size = None, False, 0, [], 0
        out: list[tuple] = []
        id_type = None

        def blocks() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], id_type), pa.array([o[1] for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.string()),
                pa.array(
                    [[{"start": s, "end": e} for s, e in o[3]] for o in out],
                    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                ),
            ], ["conv_id", "block", "formatted", "loss_spans"])
            out.clear()
            return batch

        for ids, roles, contents in arrays(batches, "conv_id", "role", "text"):
            id_type = ids.type
            for own, who, content in zip(ids.to_pylist(), roles.to_pylist(), contents.to_pylist()):
                if known and (own != at or size >= block):
                    out.append((at, number, *round_trip(held)))
                    number = number + 1 if own == at else 0
                    held, size = [], 0
                    if sum(len(o[2]) for o in out[-64:]) >= block or len(out) >= 1024:
                        yield blocks()
                at, known = own, True
                held.append((who, content))
                size += len(content) + len(who)
        if held:
            out.append((at, number, *round_trip(held)))
        if out:
            yield blocks()

    return (
        rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(
            write, f"conv_id {kind}, block long, formatted string, loss_spans array<struct<start:long,end:long>>"
        )
    )


def digests(blocks: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its blocks as :func:`formatted` gives them."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, id_type, out = None, None, None, []

        def close() -> None:
            if state is not None:
                out.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def rows() -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
            out.clear()
            return batch

        for ids, numbers, formats, spans in arrays(batches, "conv_id", "block", "formatted", "loss_spans"):
            id_type = ids.type
            for own, number, text, masked in zip(
                ids.to_pylist(), numbers.to_pylist(), formats.to_pylist(), spans.to_pylist()
            ):
                if state is None or number == 0:
                    close()
                    at, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content, _, _ in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                for span in masked:
                    content = unescape(text[span["start"]:span["end"]])
                    state[2] += len(content)
                    state[3].update(content.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(out) >= 1024:
                yield rows()
        close()
        if out:
            yield rows()

    return blocks.mapInArrow(
        read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )
