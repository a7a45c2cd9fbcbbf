"""Strict CSV, parsed in parallel.

A record may span lines, so whether a line begins inside a quoted cell depends on all lines before it.
Every split of a file is therefore followed twice, as if it began outside and inside such a cell; that gives a
row per split: where either branch ends. The rows of a file are composed in order, which settles the branch each
split is on, the line its open record began at and that record's size. Splits then parse their records at once,
each line once: a record inside a split comes out whole, one that crosses splits in pieces, which meet
by the line it began at. A record has at most MAX_ROW_BYTES, so no task holds more than that beside its batch.
A fatal fault ends its branch: no split after it yields anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.config import MAX_ROW_BYTES
from gristmill.functions.scratch import cut

CLOSED, OPEN, OVER = 0, 1, 2
_QUOTED, _PLAIN, _CELL = re.compile(rb'"(?:[^"]|"")*+"'), re.compile(rb"[^,\r]*"), re.compile(r'"((?:[^"]|"")*+)"')
_CLOSING, _TEXT = re.compile(rb'(?:[^"]|"")*+"'), re.compile(r"[^,\r\n]*")
BATCH_BYTES = 4 << 20


class CsvSyntax(ValueError):
    """Text that is no CSV record and cannot become one by more lines."""


def csv_cells(text: str) -> list[str] | None:
    """The cells of a record; None while a quoted cell is open."""
    cells, at = [], 0
    while True:
        if text.startswith('"', at):
            found = _CELL.match(text, at)
            if not found:
                return None
            cells.append(found[1].replace('""', '"'))
        else:
            found = _TEXT.match(text, at)
            cells.append(found[0])
        at = found.end()
        if len(text) - at <= 2 and text[at:] in ("", "\n", "\r\n", "\r"):
            return cells
        if text[at] != ",":
            raise CsvSyntax("invalid_csv_syntax")
        at += 1


def after_line(line: bytes, state: int) -> int:
    """The state after a line that begins in ``state``: outside a quoted cell, inside one, or broken."""
    if b'"' not in line:
        return OPEN if state == OPEN else CLOSED if line.find(b"\r") in (-1, len(line) - 1) else OVER
    at, ended = 0, False
    if state == OPEN:
        found = _CLOSING.match(line)
        if not found:
            return OPEN
        at, ended = found.end(), True
    while True:
        if not ended:
            quoted = line.startswith(b'"', at)
            found = (_QUOTED if quoted else _PLAIN).match(line, at)
            if not found:
                return OPEN
            at = found.end()
        if at == len(line) or (at == len(line) - 1 and line[at] == 13):
            return CLOSED
        if line[at] != 44:
            return OVER
        at, ended = at + 1, False


class _Branch:
    """A split followed from one state. ``began``: line of the record still open, 0 if it was open before;
    ``size``: its bytes here; ``head``: bytes up to the end of the record that was open before."""

    def __init__(self, state: int):
        self.state, self.began, self.size, self.head = state, 0, 0, None

    def feed(self, at: int, line: bytes, size: int, sound: bool) -> None:
        if self.state == OVER:
            return
        if self.state == CLOSED:
            self.began, self.size = at, 0
        carried = self.state == OPEN and not self.began
        self.size += size
        self.state = OVER if self.size > MAX_ROW_BYTES or not sound else after_line(line, self.state)
        if carried and self.state == CLOSED:
            self.head = self.size


_SUMMARY = "file string, start long, whole long, n long, size long, " + ", ".join(f"{b}_state int, {b}_began long, {b}_size long, {b}_head long" for b in ("out", "in"))
_ENTRY = "file string, start long, ahead long, state int, began long, held long, lines long, open_end boolean"


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, total, branches = None, 0, 0, ()

    def row() -> tuple:
        return (*held, n, total, *(x for b in branches for x in (b.state, b.began, b.size, b.head)))

    for batch in batches:
        for file, start, whole, line, sound in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, start, whole) != held:
                if held:
                    yield _columns([row()], _SUMMARY)
                held, n, total, branches = (file, start, whole), 0, 0, (_Branch(CLOSED), _Branch(OPEN))
            n, total = n + 1, total + len(line) + 1
            for b in branches:
                b.feed(n, line, len(line) + 1, sound)
    if held:
        yield _columns([row()], _SUMMARY)


def _entries(splits: pa.Table) -> pa.Table:
    """The splits of a file or of all its parts, a row each: the state each begins in."""
    rows = sorted(splits.to_pylist(), key=lambda r: (r["file"], r["start"]))
    lines, last = sum(r["n"] for r in rows), rows[-1]["file"]
    # Lines and newlines add up to the file's size, or to one more if its last line has no newline; a byte order mark makes that three more.
    open_end = rows[-1]["whole"] - sum(r["size"] for r in rows if r["file"] == last) in (-1, 2)
    out, ahead, state, began, held = [], 0, CLOSED, 0, 0
    for r in rows:
        out.append((r["file"], r["start"], ahead, state, began, held, lines, open_end))
        if state == OPEN and r["in_head"] is None and r["in_state"] == OPEN and not r["in_began"]:
            held += r["size"]
            state = OVER if held > MAX_ROW_BYTES else OPEN
        elif state != OVER:
            branch = "in" if state == OPEN else "out"
            crossing = state == OPEN and held + (r["in_head"] or 0) > MAX_ROW_BYTES
            state = OVER if crossing else r[f"{branch}_state"]
            began, held = ahead + r[f"{branch}_began"], r[f"{branch}_size"]
        ahead += r["n"]
    return pa.Table.from_batches([_columns(out, _ENTRY)])


_PARSED = "file string, line long, last long, cells array<string>, error string, piece binary"


class _Split:
    """Records of one split, fed line by line from the state it begins in."""

    def __init__(self, file: str, ahead: int, state: int, began: int, held: int, lines: int, open_end: bool):
        self.file, self.line, self.state, self.began, self.size, self.lines, self.open_end = file, ahead, state, began, held, lines, open_end
        self.parts: list[bytes] = []
        self.carried = state == OPEN

    def _fault(self, reason: str) -> tuple:
        self.state, self.parts = OVER, []
        return (self.file, self.line, self.line, None, reason, None)

    def feed(self, line: bytes, sound: bool) -> tuple | None:
        if self.state == OVER:
            return None
        self.line += 1
        newline = b"" if self.open_end and self.line == self.lines else b"\n"
        if self.state == CLOSED:
            self.began, self.size = self.line, 0
        self.size += len(line) + len(newline)
        if self.size > MAX_ROW_BYTES:
            return self._fault("csv_row_exceeds_1_mib")
        if not sound:
            return self._fault("invalid_utf8")
        self.parts.append(line + newline)
        self.state = after_line(line, self.state)
        if self.state == OVER:
            return self._fault("invalid_csv_syntax")
        return self._record() if self.state == CLOSED else None

    def _record(self) -> tuple | None:
        whole, self.parts = b"".join(self.parts), []
        if self.carried:
            self.carried = False
            return (self.file, self.began, self.line, None, None, whole)
        if not whole.strip(b"\r\n"):
            return (self.file, 1, self.line, [], None, None) if self.began == 1 else None
        return (self.file, self.began, self.line, csv_cells(whole.decode()), None, None)

    def end(self) -> tuple | None:
        """What is left at the end of the split: a piece, or the fault of a file that ends inside a cell."""
        if self.state != OPEN:
            return None
        if self.line == self.lines:
            return self._fault("invalid_csv_syntax")
        return (self.file, self.began, self.line, None, None, b"".join(self.parts))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, split, out, size = None, None, [], 0
    for batch in batches:
        for i, (file, start, line, sound) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
            got = []
            if (file, start) != held:
                got = [split.end()] if split else []
                held, split = (file, start), _Split(file, *(c[i].as_py() for c in batch.columns[4:]))
            for row in (*got, split.feed(line, sound)):
                if row:
                    out.append(row)
                    size += len(line)
            if size > BATCH_BYTES or len(out) >= 10_000:
                yield _columns(out, _PARSED)
                out, size = [], 0
    if split and (row := split.end()):
        out.append(row)
    if out:
        yield _columns(out, _PARSED)


def _pieced(pieces: pa.Table) -> pa.Table:
    """The record whose pieces these are; none if it never ends, whose fault is told where it shows."""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["last"])
    whole = b"".join(r["piece"] for r in rows)
    blank = not whole.strip(b"\r\n")
    try:
        cells = [] if blank else csv_cells(whole.decode())
    except (CsvSyntax, UnicodeDecodeError):
        cells = None
    none = cells is None or (blank and rows[0]["line"] != 1)
    return pa.Table.from_batches([_columns([(rows[0]["file"], rows[0]["line"], rows[-1]["last"], cells, None, None)], _PARSED)]).slice(0, 0 if none else 1)


def csv_records(spark: SparkSession, path: str | list[str], parts: bool = False) -> DataFrame:
    """``file, line, last, cells, error, names``: the records of CSV files, their first and last lines, and each
    file's header; ``error`` is a fatal fault. The record of line 1 is the header itself. With ``parts``, the files are
    the parts of one file, whose ``file`` is empty."""
    one = F.lit("") if parts else F.col("file")
    where = {"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start"), "whole": F.col("_metadata.file_size")}
    lines = spark.read.option("lineSep", "\n").text(path).select(*(c.alias(n) for n, c in where.items()), F.col("value").cast("binary").alias("value"), F.is_valid_utf8("value").alias("sound"))
    splits = lines.mapInArrow(_summaries, _SUMMARY)
    entries = cut(splits.groupBy(one.alias("of")).applyInArrow(_entries, _ENTRY), "splits")
    placed = lines.drop("whole").join(F.broadcast(entries), ["file", "start"])  # a row per split; lines keep their order
    parsed = cut(placed.select("file", "start", "value", "sound", "ahead", "state", "began", "held", "lines", "open_end").mapInArrow(_records, _PARSED).withColumn("file", one), "csv")
    joined = parsed.where("piece is not null").groupBy("file", "line").applyInArrow(_pieced, _PARSED)
    records = parsed.where("piece is null").unionByName(joined)
    header = cut(records.where("line = 1 and error is null").select("file", F.col("cells").alias("names")), "headers")
    return records.join(F.broadcast(header), "file", "left").select("file", "line", "last", "cells", "error", "names")  # a header per file, 1 MiB at most


def named(line: int, last: int, cells: list[str] | None, error: str | None, names: list[str] | None, fault: Any, record: Any) -> Any:
    """The record of a row of ``csv_records``, or its fault; None for a sound header and for all rows of a file without one."""
    unfit = names is not None and (not names or not all(names) or len(set(names)) < len(names))
    if unfit:
        return fault(last, "csv_requires_unique_nonempty_headers", True) if line == 1 and error is None else None
    if error is not None:
        return fault(line, error, True)
    if line == 1:
        return None
    if len(cells) != len(names):
        return record(line, {"_invalid_csv_values": cells}, "csv_column_count_mismatch")
    return record(line, dict(zip(names, cells, strict=True)))
