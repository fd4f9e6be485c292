"""Chat formatting by incremental rendering of a black-box template.

A template is a function from a list of (role, text) turns to a string. Its output is never
parsed to find the turns: the prefixes of a conversation are rendered one after another, and what
an output adds to the one before it is the span of the turn that was added. Where an output does
not begin with the one before, the template rewrites what it had written; such turns are reported.
The text inside a span is found by rendering the same prefix with two probe texts: what both
outputs share before and after the probe is the turn's head and foot.

A conversation is cut into blocks of ``block`` turns, so that one of any length is spread over many
tasks and rendering stays linear. A block is rendered after the ``2 * context`` turns before it, for
templates whose output for a turn depends on the turn, on at most ``context`` turns before it, and
on nothing else. That is checked: the last ``context`` of the turns before a block must get the
same spans there as in their own block. A template that depends on more (a count of all turns)
takes ``block=None``: whole conversations, each in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from postkit.llm.common import BATCH_ROWS, field
from postkit.session import materialize

Turn = tuple[str, str]

#: Strings that the template itself writes. Inside texts and roles they are escaped.
CONTROL = r"</?s>|\[/?INST\]|\[/?TURN\]|\[ROLE\]"
_PLAIN = re.compile(rf"(\\*)({CONTROL})")
_ESCAPED = re.compile(rf"(\\+)({CONTROL})")


def escape(text: str) -> str:
    """A control string after k backslashes gets 2 k + 1 of them; nothing else changes."""
    return _PLAIN.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][:len(m[1]) // 2] + m[2], text)


def instruct(turns: list[Turn]) -> str:
    """The default template: user turns in ``[INST]``, assistant turns bare up to ``</s>``, any other role named."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"<s>[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)} </s>")
        else:
            out.append(f"<s>[TURN] {escape(role)} [ROLE] {escape(text)} [/TURN]")
    return "".join(out)


def read_back(formatted: str) -> Iterator[Turn]:
    """The turns of an output of ``instruct``, from the output alone. Inside texts every control string
    stands behind a backslash, so one behind a space is the template's."""
    at = 0
    while at < len(formatted):
        if formatted.startswith("<s>[INST] ", at):
            end = formatted.index(" [/INST]", at + 10)
            role, text, at = "user", formatted[at + 10:end], end + 8
        elif formatted.startswith("<s>[TURN] ", at):
            middle = formatted.index(" [ROLE] ", at + 10)
            end = formatted.index(" [/TURN]", middle + 8)
            role, text, at = unescape(formatted[at + 10:middle]), formatted[middle + 8:end], end + 8
        else:
            end = formatted.index(" </s>", at + 1)
            role, text, at = "assistant", formatted[at + 1:end], end + 5
        yield role, unescape(text)


@dataclass
class Span:
    """A turn in an output: characters [start, end), those of its text (where it was looked for and found
    whole, else -1), and how many characters written before it the template changed to add it."""

    role: str
    start: int
    end: int
    text_start: int
    text_end: int
    rewritten: int


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def locate(template: Callable[[list[Turn]], str], turns: list[Turn], loss_roles: Iterable[str], first: int = 0,
           plain: Callable[[str], str] = unescape) -> tuple[str, list[Span]]:
    """Output of the turns and the spans of those from number ``first`` on."""
    out, spans = template(turns[:first]) if first else "", []
    for i in range(first, len(turns)):
        role, text = turns[i]
        more = template(turns[:i + 1])
        start = len(out) if more.startswith(out) else _shared(out, more)
        found = (-1, -1)
        if role in loss_roles:
            a, b = (template([*turns[:i], (role, probe)]) for probe in "ab")
            head, foot = _shared(a, b), _shared(a[::-1], b[::-1])
            if a[head:len(a) - foot] == "a" and len(more) >= head + foot and plain(more[head:len(more) - foot]) == text:
                found = (head, len(more) - foot)
        spans.append(Span(role, start, len(more), *found, len(out) - start))
        out = more
    return out, spans


def _positions(convs: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """The rows with ``pos``, the place of each in its conversation, and ``total``. Rows are sorted by range, so the rows of
    one conversation are dealt over tasks; a place is the offset of the sorted part plus the place in it."""
    rows = convs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    rows = rows.withColumn("role", F.coalesce(F.col("role").cast("string"), F.lit(""))).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    done = materialize(rows.orderBy(*names).withColumn("at", F.monotonically_increasing_id()), "turns")
    part, low = F.shiftright("at", 33), (1 << 33) - 1
    sizes = done.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    pieces = done.groupBy("conv", part.alias("part")).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    bounds = (pieces.join(starts, "part").groupBy("conv").agg(
        F.min(F.col("offset") + F.col("at").bitwiseAND(low)).alias("begin"), F.sum("n").alias("total"))).withColumnRenamed("conv", "of")
    placed = done.join(starts, part == starts["part"]).drop("part")
    return placed.join(bounds, F.col("conv").eqNullSafe(F.col("of"))).select(
        *names, (F.col("offset") + F.col("at").bitwiseAND(low) - F.col("begin")).alias("pos"), "total")


def _grouped(batches, keys: int):
    """(key, rows) of consecutive rows with equal first ``keys`` columns; a group's rows are read while they are used."""
    def rows():
        for b in batches:
            for i in range(0, b.num_rows, BATCH_ROWS):
                yield from zip(*[c.to_pylist() for c in b.slice(i, BATCH_ROWS).columns], strict=True)
    return groupby(rows(), key=lambda r: r[:keys])


def _written(run, schema: T.StructType):
    """``run``, which yields tuples, as a function of Arrow batches."""
    kinds = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def batches_of(batches):
        for rows in batched(run(batches), BATCH_ROWS):
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    return batches_of


_SPAN = T.StructType([T.StructField("role", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("start", "end", "text_start", "text_end", "rewritten")]])


def format_conversations(convs: DataFrame, template: Callable[[list[Turn]], str] = instruct, block: int | None = 32, context: int = 1,
                         loss_roles: tuple[str, ...] = ("assistant",), plain: Callable[[str], str] = unescape, id_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per block of a conversation: its id, ``block`` (from 0), ``formatted`` (blocks in order, joined, are the output),
    ``spans`` (of every turn, as in ``Span``, from the block's first character), ``head`` and ``foot`` (digests for ``checked``).

    Turns are in order of ``turn_col`` (nulls first), then role and text; repeated rows are turns of their own. Null roles and texts
    are empty; null ids are one conversation; an empty table gives no rows; other columns are ignored, whatever their names."""
    if block is not None and (context < 1 or block < 2 * context):
        raise ValueError("a block holds at least 2 * context turns, and the context at least one")
    names, lead = ["conv", "turn", "role", "text"], 2 * context
    rows = _positions(convs, [id_col, turn_col, role_col, text_col], names)
    if block is None:
        rows = rows.select("conv", F.lit(0).cast("long").alias("block"), "pos", "role", "text")
    else:
        own = F.floor(F.col("pos") / block)
        both = (F.col("pos") % block >= block - lead) & (F.floor((F.col("total") - 1) / block) > own)
        rows = rows.select("conv", F.explode(F.when(both, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"), "pos", "role", "text")
    schema = T.StructType([field(convs, id_col), T.StructField("block", T.LongType()), T.StructField("formatted", T.StringType()),
                           T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("head", T.StringType()), T.StructField("foot", T.StringType())])

    def digest(out: str, spans: list[Span], shift: int) -> str:
        return hashlib.sha256("\n".join(f"{s.start - shift},{s.end - shift},{out[s.start:s.end]}" for s in spans).encode()).hexdigest()

    def run(batches):
        for (conv, number), group in _grouped(batches, 2):
            turns, first = [], 0
            for _, _, pos, role, text in group:
                first += block is not None and pos < number * block
                turns.append((role, text))
            out, spans = locate(template, turns, loss_roles, max(0, first - context), plain)
            before, own = spans[:min(first, context)], spans[min(first, context):]
            shift = own[0].start if first else 0
            found = [{"role": s.role, "start": s.start - shift, "end": s.end - shift, "rewritten": s.rewritten,
                      "text_start": s.text_start - shift if s.text_start >= 0 else -1,
                      "text_end": s.text_end - shift if s.text_end >= 0 else -1} for s in own]
            yield (conv, number, out[shift:], found, digest(out, before, shift) if first else None,
                   digest(out, own[-context:], own[-1].end) if block is not None else None)

    return rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos").mapInArrow(_written(run, schema), schema)


def digests(blocks: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), read: Callable[[str], Iterable[Turn]] = read_back,
            plain: Callable[[str], str] = unescape) -> DataFrame:
    """One row per conversation, read from its blocks alone: ``n_turns``, ``turns_sha256`` (role, line feed, text, line feed of each
    turn), ``loss_chars`` and ``loss_sha256`` (texts under the loss mask), ``formatted_chars``, ``rewritten`` (turns for which the
    template changed what it had written) and ``whole`` (every loss text was found, no turn rewrote, and blocks agree on the
    turns they share). A digest runs over all text of a conversation: its blocks are streamed through one task, one at a time."""
    id_col = blocks.columns[0]
    schema = T.StructType([blocks.schema[id_col], *[T.StructField(n, t) for n, t in (
        ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()),
        ("formatted_chars", T.LongType()), ("rewritten", T.LongType()), ("whole", T.BooleanType()))]])
    mask = F.filter("spans", lambda s: s["role"].isin(*loss_roles)).alias("mask")
    rewritten = F.size(F.filter("spans", lambda s: s["rewritten"] > 0)).alias("rewritten")

    def run(batches):
        for (conv,), group in _grouped(batches, 1):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = total = changed = 0
            whole, last = True, None
            for _, _, formatted, mask, rewritten, head, foot in group:
                for role, text in read(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for s in mask:
                    if s["text_start"] < 0:
                        whole = False
                        continue
                    text = plain(formatted[s["text_start"]:s["text_end"]])
                    loss.update(text.encode())
                    chars += len(text)
                total += len(formatted)
                changed += rewritten
                whole, last = whole and not rewritten and head == last, foot
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, changed, whole

    return (blocks.select(id_col, "block", "formatted", mask, rewritten, "head", "foot").repartition(F.col(id_col))
            .sortWithinPartitions(id_col, "block").mapInArrow(_written(run, schema), schema))
