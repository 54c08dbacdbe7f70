"""Rows that fail to parse: load the valid rows, set the others apart with the reason.

One narrow pass: every Arrow batch of raw lines goes through pyarrow's CSV
reader, whose invalid-row callback reports the rows of a wrong width; fields are
read as strings, then cast as vectors, and each failing cell is labelled.  There
is no shuffle, so the cost grows with the input and skew cannot arise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text parsed at once, so that a batch of very long lines stays small in memory.
BLOCK_BYTES = 32 << 20

#: Patterns of the castable types; a cell that does not match fails the cast.
CAST_PATTERNS = {
    "bigint": r"^[+-]?[0-9]+$",
    "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$",
}
_ARROW = {"bigint": pa.int64(), "double": pa.float64()}


@dataclass(frozen=True)
class LineFormat:
    """How a line is laid out.

    ``patterns`` maps a field to the RE2 pattern its trimmed value must match,
    ``casts`` maps a field to ``bigint`` or ``double``.  Reasons, in order of
    precedence: ``quoting``, ``column_count``, ``invalid_value``.
    """

    fields: tuple[str, ...]
    patterns: dict[str, str] = field(default_factory=dict)
    casts: dict[str, str] = field(default_factory=dict)
    delimiter: str = "\t"
    comment: str = "#"
    skip_header: bool = True


def _unused_characters(text: str, count: int) -> list[str]:
    """Private characters that do not occur in ``text``."""
    found = []
    for code in range(0xE000, 0xF8FF):
        if chr(code) not in text:
            found.append(chr(code))
            if len(found) == count:
                break
    return found


def _structural(lines: pa.Array, fmt: LineFormat) -> tuple[list[pa.Array], list[int], list[int]]:
    """Fields of the rows of the right width; the positions kept; the positions rejected.

    A first row of the right width is put before the others, so the reader
    neither sees an empty file nor eats a byte-order mark of the data.
    """
    width = len(fmt.fields)
    values = lines.to_pylist()
    swaps: list[tuple[str, str]] = []
    if any("\n" in v or "\r" in v for v in values):
        swaps = list(zip("\n\r", _unused_characters("".join(values), 2)))
        for there, here in swaps:
            values = [v.replace(there, here) for v in values]
    data = (fmt.delimiter.join(["x"] * width) + "\n" + "\n".join(values)).encode()
    rejected: list[int] = []

    def on_invalid(row: pacsv.InvalidRow) -> str:
        rejected.append(row.number - 2)  # physical rows count from 1, and ours is the first
        return "skip"

    table = pacsv.read_csv(
        pa.BufferReader(data),
        read_options=pacsv.ReadOptions(use_threads=False, column_names=list(fmt.fields), block_size=len(data) + 1),
        parse_options=pacsv.ParseOptions(
            delimiter=fmt.delimiter, quote_char='"', double_quote=True, escape_char=False,
            newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=on_invalid,
        ),
        convert_options=pacsv.ConvertOptions(
            column_types={f: pa.string() for f in fmt.fields}, strings_can_be_null=False, quoted_strings_can_be_null=False
        ),
    )
    columns = []
    for name in fmt.fields:
        column = table.column(name).combine_chunks().slice(1)
        for there, here in swaps:
            column = pc.replace_substring(column, here, there)
        columns.append(column)
    bad = set(rejected)
    kept = [i for i in range(len(values)) if i not in bad]
    if any(len(c) != len(kept) for c in columns):
        raise RuntimeError("the CSV reader lost the row numbers")
    return columns, kept, rejected


def cast_column(values: pa.Array, kind: str) -> pa.Array:
    """Cells as ``bigint`` or ``double``; null where a cell is no such number or does not fit."""
    good = pc.match_substring_regex(values, CAST_PATTERNS[kind])
    if kind == "bigint":
        minus = pc.starts_with(values, "-")
        digits = pc.replace_substring_regex(values, "^[+-]?0*", "")
        size = pc.utf8_length(digits)
        limit = pc.if_else(minus, "9223372036854775808", "9223372036854775807")
        good = pc.and_(good, pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(digits, limit))))
        values = pc.replace_substring_regex(values, "^[+]", "")
    return pc.cast(pc.if_else(good, values, pa.scalar(None, values.type)), _ARROW[kind])


def parse_block(lines: pa.Array, fmt: LineFormat) -> tuple[pa.Array, list[pa.Array], pa.Array]:
    """(reason, fields, bad field), each as long as ``lines``.

    ``reason`` is null for a loaded line, ``skip`` for one that is no record.
    """
    n = len(lines)
    lines = pc.if_else(pc.ends_with(lines, "\r"), pc.utf8_slice_codeunits(lines, 0, -1), lines)
    text = pc.fill_null(lines, "")
    head = pc.utf8_ltrim_whitespace(text)
    skipped = pc.or_(pc.equal(head, ""), pc.starts_with(head, fmt.comment) if fmt.comment else pa.scalar(False))
    delimiter = "\\t" if fmt.delimiter == "\t" else "\\x{%x}" % ord(fmt.delimiter)
    cell = f'(?:"(?:[^"]|"")*"|[^"{delimiter}]*)'
    sane = pc.match_substring_regex(text, f"^{cell}(?:{delimiter}{cell})*$")
    reason: list[str | None] = [None] * n
    culprit: list[str | None] = [None] * n
    fields = [pa.nulls(n, _ARROW.get(fmt.casts.get(f, ""), pa.string())) for f in fmt.fields]
    for i, (skip, ok) in enumerate(zip(skipped.to_pylist(), sane.to_pylist())):
        reason[i] = "skip" if skip else None if ok else "quoting"
    todo = [i for i in range(n) if reason[i] is None]
    if todo:
        columns, kept, rejected = _structural(text.take(pa.array(todo)), fmt)
        for i in rejected:
            reason[todo[i]] = "column_count"
        trimmed = [pc.utf8_trim_whitespace(c) for c in columns]
        header = None
        if fmt.skip_header:
            for name, values in zip(fmt.fields, trimmed):
                same = pc.equal(pc.utf8_lower(values), name.lower())
                header = same if header is None else pc.and_(header, same)
        fails, parsed = {}, []
        for name, values in zip(fmt.fields, trimmed):
            kind = fmt.casts.get(name)
            parsed.append(cast_column(values, kind) if kind else values)
            misses = [pc.invert(pc.match_substring_regex(values, fmt.patterns[name]))] if name in fmt.patterns else []
            misses += [pc.is_null(parsed[-1])] if kind else []
            if misses:
                fails[name] = misses[0] if len(misses) == 1 else pc.or_(*misses)
        masks = {name: m.to_pylist() for name, m in fails.items()}
        heads = header.to_pylist() if header is not None else [False] * len(kept)
        source: list[int | None] = [None] * n  # the parsed row of each line
        for j, i in enumerate(kept):
            at = todo[i]
            if heads[j]:
                reason[at] = "skip"
                continue
            for name, mask in masks.items():
                if mask[j]:
                    reason[at], culprit[at] = "invalid_value", name
                    break
            else:
                source[at] = j
        rows = pa.array(source, pa.int64())
        fields = [values.take(rows) for values in parsed]
    return pa.array(reason, pa.string()), fields, pa.array(culprit, pa.string())


def parse_lines(df: DataFrame, line: str, keep: list[str], fmt: LineFormat) -> DataFrame:
    """Parse ``df[line]``; a row per record, loaded or failed.

    Returns ``keep`` plus ``record`` (a struct of the fields, null for a failed
    line), ``reason`` (null for a loaded line) and ``bad_field``.  The parsed
    fields stay inside the struct, so a kept column may share a field's name.
    Defined cases: a null, blank or whitespace-only line, a comment and a header
    give no row; an empty table gives an empty result; repeated lines are
    separate records; there is no limit on a line's length; a line feed or
    carriage return inside a line is text.
    """
    spark_types = {"bigint": T.LongType(), "double": T.DoubleType()}
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{line}`").cast("string").alias("line"))
    schema = T.StructType(
        [*source.schema.fields[:-1], *[T.StructField(f"f{i}", spark_types.get(fmt.casts.get(f, ""), T.StringType())) for i, f in enumerate(fmt.fields)],
         T.StructField("reason", T.StringType()), T.StructField("bad_field", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            size = max(1, batch.num_rows * BLOCK_BYTES // max(batch.nbytes, BLOCK_BYTES))
            while at < batch.num_rows:
                part = batch.slice(at, size)
                at += size
                reason, fields, culprit = parse_block(part.column(part.num_columns - 1), fmt)
                out = pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *fields, reason, culprit], names=[f.name for f in schema.fields]
                )
                yield out.filter(pc.fill_null(pc.not_equal(reason, "skip"), True))

    parsed = source.mapInArrow(run, schema)
    record = F.struct(*[F.col(f"f{i}").alias(f) for i, f in enumerate(fmt.fields)])
    return parsed.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.when(F.col("reason").isNull(), record).alias("record"), "reason", "bad_field",
    )


#: A small-RNA annotation line: a name and a sequence of 15 to 35 nucleotides.
SRNA_LINES = LineFormat(fields=("name", "sequence"), patterns={"sequence": "^[ACGTUNacgtun]{15,35}$"})
