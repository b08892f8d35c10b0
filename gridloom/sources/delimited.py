"""Delimited text files: quoted fields, ragged rows, no types.

One task reads a file's rows with a state machine that Spark's own source has not: a quote opens a field only at its start,
carriage returns outside quotes are dropped, and rows of empty fields alone are left out. A file is bounded by the
binary source's 2 GB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import DELIMITERS, sniff_delimiter
from gridloom.shipping import ship

ROWS = "array<array<string>>"


def parse_rows(text: str, delimiter: str) -> list[list[str]]:
    """Fields of all rows with a non-empty field; an open quote ends with the text."""
    plain = re.compile(f'[^"\r\n{re.escape(delimiter)}]+')
    rows: list[list[str]] = []
    row: list[str] = []
    parts: list[str] = []
    at, end = 0, len(text)

    def close_row(line_end: bool) -> None:
        nonlocal row
        field = "".join(parts)
        row.append(field.removesuffix("\r") if line_end else field)  # of a quoted field; others hold none
        parts.clear()
        if any(row):
            rows.append(row)
        row = []

    while at < end:
        if m := plain.match(text, at):
            parts.append(m[0])
            at = m.end()
            continue
        c = text[at]
        at += 1
        if c == '"' and not any(parts):
            while True:  # to the closing quote
                close = text.find('"', at)
                parts.append(text[at:] if close < 0 else text[at:close])
                at = end if close < 0 else close + 1
                if close < 0 or text[at : at + 1] != '"':
                    break
                parts.append('"')
                at += 1
        elif c == delimiter:
            row.append("".join(parts))
            parts.clear()
        elif c == "\n":
            close_row(True)
        elif c != "\r":
            parts.append(c)
    if row or any(parts):
        close_row(False)
    return rows


def sniffed(text: str) -> str:
    """The delimiter that functions.sniff_delimiter finds."""
    lines = [x for x in re.split("\r\n|\n|\r", text) if x.strip()][:10]
    counts = {mark: [x.count(mark) for x in lines] for mark in DELIMITERS}
    even = {mark: n[0] for mark, n in counts.items() if n and min(n) == max(n) and n[0]}
    return max(even, key=even.__getitem__, default=DELIMITERS[0])


def delimited_rows(texts: DataFrame, text: str = "text", delimiter: str | None = None, out: str = "rows") -> DataFrame:
    """texts with the rows of fields of every text; the delimiter is sniffed unless given. Null has no rows."""
    ship(texts.sparkSession)

    @F.arrow_udf(ROWS)
    def parsed(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.list_(pa.string()))
        for column, marks in pairs:
            yield pa.array([parse_rows(t or "", d) for t, d in zip(column.to_pylist(), marks.to_pylist(), strict=True)], kind)

    mark = sniff_delimiter(F.col(text)) if delimiter is None else F.lit(delimiter)
    return texts.withColumn(out, parsed(F.col(text), mark))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, has_header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """file_name, sheet_name, header_row_count, rows of every file below path."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode("content", encoding).alias("text"))
    sheet = F.regexp_replace("file_name", r"\.[^.]*$", "")
    head = F.when(F.size("rows") > 0, F.lit(int(has_header))).otherwise(0)
    return delimited_rows(files, delimiter=delimiter).select("file_name", sheet.alias("sheet_name"), head.alias("header_row_count"), "rows")
