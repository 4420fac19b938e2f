"""Conversations rendered with a compiled template, and read back from what was rendered."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import _parse_datatype_string

from paperloom.llm.common import python_ready
from paperloom.llm.templates import Template

#: Strings that mark turns; none of them occurs in an escaped text.
CONTROLS = ("</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}</s>{% endif %}"
    "{% endfor %}"
)

#: A control string, perhaps with backslashes after its first character.
CONTROL_PATTERN = r"([<\[])(\\*)(/s>|INST\]|/INST\]|ROLE\]|/ROLE\])"
_CONTROL = re.compile(CONTROL_PATTERN)
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/s>|INST\]|/INST\]|ROLE\]|/ROLE\])")


def escape(text: str) -> str:
    """One backslash more in every control string, so that none is left whole."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


PIECES = "conv_id long, seq long, start long, piece string, loss array<struct<start: long, end: long>>"


def _stream(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def _batches(rows: Iterator[tuple], schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held = to_arrow_schema(schema), []

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow, strict=True)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pack()
            held = []
    if held:
        yield pack()


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with the same first value, each streamed."""
    from itertools import groupby

    yield from groupby(rows, key=lambda r: r[0])


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """`rows` (conv_id, turn, role, text) as ``conv_id, seq, start, piece, loss``, one row per turn.

    A conversation's formatted text is its pieces in order of ``seq``; ``start`` is the
    piece's place in it and ``loss`` the places of what is to be learned, in code points.
    Turns are ordered by turn, then role, then text, null first; null role and text are
    empty; repeated rows are turns of their own; a null conv_id is one conversation.

    Conversations are sorted within partitions and streamed through the template, so one
    of any length needs the memory of two turns.
    """
    python_ready(rows.sparkSession)
    schema = _parse_datatype_string(PIECES)

    def run(batches):
        compiled = Template(template, escape)

        def produce():
            for conv_id, turns in _groups(_stream(batches, ["conv_id", "role", "text"])):
                start = 0
                for seq, (piece, spans) in enumerate(compiled.pieces((r or "", t or "") for _, r, t in turns)):
                    yield conv_id, seq, start, piece, [{"start": a, "end": b} for a, b in spans]
                    start += len(piece)

        yield from _batches(produce(), schema)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return ordered.mapInArrow(run, schema)


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """``role, text`` of the turns in formatted text."""
    at = 0
    while at < len(text):
        role, end = "assistant", "</s>"
        if text.startswith("[INST] ", at):
            role, end, at = "user", " [/INST]", at + 7
        elif text.startswith("[ROLE]", at):
            close = text.index("[/ROLE]", at)
            role, at = unescape(text[at + 6 : close]), close + 7
        close = text.index(end, at)
        yield role, unescape(text[at:close])
        at = close + len(end)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_conversations(pieces: DataFrame) -> DataFrame:
    """What the formatted conversations hold, parsed from their pieces: turns and learned text as digests."""
    schema = _parse_datatype_string(READ)

    def run(batches):
        def produce():
            for conv_id, parts in _groups(_stream(batches, ["conv_id", "start", "piece", "loss"])):
                turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, start, piece, spans in parts:
                    for role, text in parse_turns(piece):
                        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        n_turns += 1
                    for span in spans:
                        learned = unescape(piece[span["start"] - start : span["end"] - start])
                        loss.update(learned.encode("utf-8", "surrogatepass"))
                        loss_chars += len(learned)
                    chars += len(piece)
                yield conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _batches(produce(), schema)

    order = [F.col("conv_id").asc_nulls_first(), F.col("seq")]
    return pieces.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)
