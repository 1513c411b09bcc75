"""Chat formatting with a compiled template, and reading it back.

A turn becomes ``### role: text</turn>\\n``.  In roles and texts a backslash stands
before each backslash, ``#`` and ``</turn>`` (in roles also before ``:`` and a newline),
so control strings occur in the output only as control, and unescaping is exact.
The text of assistant turns is under the generation marker: the loss mask.

Rows are ordered by conv_id, turn, role and text (nulls first) within their
partition and stream through the template, so the longest conversation takes
the memory of a batch of rows.  A formatted turn is one output row; the output
of a conversation is its rows' text in order.

Defined results: null texts and roles are empty ones; rows with the same turn all
count, ordered by role and text; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import table
from .template import Template

#: The conversation that holds control strings itself.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"
TURN_END = "</turn>"
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | label }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
FORMATTED = "conv_id long, turn_index long, formatted string, mask_start array<long>, mask_end array<long>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_CONTROL = re.compile(r"\\|#|</turn>")
_LABEL = re.compile(r"\\|#|</turn>|:|\n")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str | None) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text or "")


def label(text: str | None) -> str:
    return _LABEL.sub(lambda m: "\\" + m[0], text or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str | None], str]] = {"escape": escape, "label": label}


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, role and text, each conversation in one partition and in order; partitions are streamed, not held."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches of size rows, or fewer if their third column exceeds most characters."""
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += len(row[2] or "")
        if len(held) >= size or chars >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_turns(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """FORMATTED: one row a turn, in order, with the spans of the turn's formatted text that are under the generation marker.

    A row ends where the template itself gives TURN_END and a newline; a template that never does gives one row a conversation.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("turn_index", pa.int64()), ("formatted", pa.string()), ("mask_start", pa.list_(pa.int64())), ("mask_end", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, FILTERS)

        def formatted() -> Iterator[tuple]:
            for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
                messages = ({"role": role, "text": text} for _, role, text in rows)
                text, start, end, size, at = [], [], [], 0, 0
                for part, marked in compiled.parts(messages=messages):
                    text.append(part)
                    if marked and part:
                        if end and end[-1] == size:
                            end[-1] = size + len(part)
                        else:
                            start.append(size)
                            end.append(size + len(part))
                    size += len(part)
                    if not marked and part == TURN_END + "\n":
                        yield conv_id, at, "".join(text), start, end
                        text, start, end, size, at = [], [], [], 0, at + 1
                if text:
                    yield conv_id, at, "".join(text), start, end

        yield from _batches(formatted(), schema)

    return ordered(turns).mapInArrow(run, FORMATTED)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; control strings count only where they aren't escaped."""
    if not formatted.startswith("### ") or not formatted.endswith(TURN_END + "\n"):
        raise ValueError(f"not a formatted turn: {formatted[:60]!r}")
    body = formatted[4 : -len(TURN_END) - 1]
    cut = next(m.start() for m in re.finditer(r"\\.|: ", body, re.S) if m[0] == ": ")
    return unescape(body[:cut]), unescape(body[cut + 2 :])


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, from the formatted turns alone (in order, as format_turns gives them)."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
                turns, loss, n, learned, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, _, text, starts, ends in rows:
                    role, content = parse_turn(text)
                    turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                    n, chars = n + 1, chars + len(text)
                    for a, b in zip(starts, ends, strict=True):
                        part = unescape(text[a:b])
                        loss.update(part.encode("utf-8", "surrogatepass"))
                        learned += len(part)
                yield conv_id, n, turns.hexdigest(), learned, loss.hexdigest(), chars

        yield from _batches(digests(), schema)

    return formatted.mapInArrow(run, DIGESTS)


def probe(spark: SparkSession) -> DataFrame:
    return spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(probe(spark))))
