"""Tables in markup whose cells span rows: cells that stand where a span already is, blank spans below a cell, and the
columns of a row with the cells that reach into it from above."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.python import ready
from .rows import _CELL, _SPAN, Cell, Grid

_ROW = re.compile(r"<tr[^>]*>.*?</tr>", re.S | re.I)


def read(html: str | None) -> list[tuple[str, list[Cell]]]:
    """Rows of a table: the markup of each and its cells."""
    return [(row, [Cell(*c) for c in _CELL.findall(row)]) for row in _ROW.findall(html or "")]


def _cell(attrs: str, text: str) -> str:
    attrs = attrs.strip()
    return f"<td {attrs}>{text}</td>" if attrs else f"<td>{text}</td>"


def _table(rows: list[str]) -> str:
    return "<table>\n" + "\n".join(rows) + "\n</table>"


def without_covered(html: str | None) -> str:
    """Cells that stand in a column which a span from above holds go; a row that would have none left stays as it is, as
    do rows without cells. What is left is not moved, and nothing is added, so doing it again changes nothing where no
    cell was dropped."""
    held: dict[int, int] = {}
    out = []
    for row, cells in read(html):
        at, kept = 0, []
        for cell in cells:
            if held.get(at, 0) > 0:
                at += 1
                continue
            wide = cell.span("colspan")
            if re.search(_SPAN.format("rowspan"), cell.attrs, re.I):
                for c in range(at, at + wide):
                    held[c] = max(held.get(c, 0), cell.span("rowspan"))
            kept.append(_cell(cell.attrs, cell.text))
            at += wide
        held = {c: n - 1 for c, n in held.items() if n > 1}
        out.append("<tr>" + "".join(kept) + "</tr>" if kept else row)
    return _table(out)


def absorbed(html: str | None) -> str:
    """A blank cell that spans rows but not columns goes if the cell above it in its column, the one with the most rows or
    the first with text, spans rows or is blank too; that cell then also spans its rows. Spans of 1 are not written."""
    held: dict[int, int] = {}
    above: dict[int, Cell] = {}
    high: dict[int, int] = {}  # by identity of a cell, the rows that it spans by now
    out = []
    for _, cells in read(html):
        at, kept = 0, []
        for cell in cells:
            rows, wide, blank = cell.span("rowspan"), cell.span("colspan"), not cell.text.strip()
            hollow = blank and rows > 1 and wide == 1
            if not (hollow and held.get(at, 0) > 0):
                while held.get(at, 0) > 0:
                    at += 1
                if rows > 1:
                    for c in range(at, at + wide):
                        held[c] = max(held.get(c, 0), rows)
            start, at = at, at + wide
            anchor = above.get(start)
            if hollow and anchor is not None and (high[id(anchor)] > 1 or not anchor.text.strip()):
                high[id(anchor)] += rows
                continue
            high[id(cell)] = rows
            kept.append(cell)
            if (rows > 1 and (anchor is None or rows > high[id(anchor)])) or (anchor is None and not blank):
                above[start] = cell
        held = {c: n - 1 for c, n in held.items() if n > 1}
        out.append(kept)

    def written(cell: Cell) -> str:
        for name, n in (("rowspan", high[id(cell)]), ("colspan", cell.span("colspan"))):
            if n > 1:
                cell.widen(name, n)
            else:
                cell.attrs = re.sub(_SPAN.format(name), "", cell.attrs, flags=re.I).strip()
        return _cell(cell.attrs, cell.text)

    return _table(["<tr>" + "".join(map(written, row)) + "</tr>" for row in out])


@dataclass(frozen=True)
class Place:
    """A column of a row: its cell's text, and, if that cell stands in an earlier row, which one and how high it is."""

    text: str
    attrs: str
    start_row: int | None = None
    high: int = 1


def columns_of(html: str | None, row_no: int) -> list[Place]:
    """The columns of a row, one for each that a cell from above or one of its own holds; of a cell of its own that spans
    columns only the first has text. No columns if there is no such row."""
    rows = [cells for _, cells in read(html)]
    if not 0 <= row_no < len(rows):
        return []
    grid, born = Grid(), {}
    for k, row in enumerate(rows[:row_no]):
        born |= {id(c): k for c in row}
        grid.put(row)
        grid.next()
    own = iter([Place(c.text if k == 0 else "", c.attrs if k == 0 else "") for c in rows[row_no] for k in range(c.span("colspan"))])
    wide = max(len(grid.held) + sum(c.span("colspan") for c in rows[row_no]), max(grid.held, default=-1) + 1)
    places = []
    for col in range(wide):
        cell = grid.held.get(col, (None,))[0]
        places.append(next(own, Place("", "")) if cell is None else Place(cell.text, cell.attrs, born[id(cell)], cell.span("rowspan")))
    return places


def rewritten(tables: DataFrame, rewrite: Callable[[str | None], str]) -> DataFrame:
    """(doc_id, html) -> (doc_id, html), each table rewritten by itself (without_covered, absorbed). Null markup has no
    rows. Batches of tables stream through the tasks; nothing is shuffled."""
    ready(tables.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rewrite(h) for h in b.column(1).to_pylist()], pa.string())], schema=schema)

    return tables.selectExpr("cast(doc_id as long) doc_id", "html").mapInArrow(run, "doc_id long, html string")


def row_columns(tables: DataFrame) -> DataFrame:
    """(doc_id, html, row_no) -> (doc_id, col, text, start_row, high): the columns of a row of each table (see columns_of);
    start_row is null where the cell is the row's own."""
    ready(tables.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("col", pa.int32()), ("text", pa.string()), ("start_row", pa.int32()), ("high", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(doc, k, p) for doc, html, row in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, p in enumerate(columns_of(html, -1 if row is None else row))]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()), *[pa.array([getattr(g[2], n) for g in got], kind) for n, kind in (("text", pa.string()), ("start_row", pa.int32()), ("high", pa.int32()))]], schema=schema)

    return tables.selectExpr("cast(doc_id as long) doc_id", "html", "cast(row_no as int) row_no").mapInArrow(run, "doc_id long, col int, text string, start_row int, high int")
