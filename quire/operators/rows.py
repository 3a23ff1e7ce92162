"""Tables in markup that go on over pages: their rows read, joined where a row was cut by the page's end, and written.

A cell is an object that stands in one row and may hold columns of later ones; joining changes the objects, so what a
span from above holds is changed where it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.python import ready

# What marks rows, cells and spans, and what joins the halves of a cell.
_ROW = re.compile(r"<tr[^>]*>(.*?)</tr>", re.S | re.I)
_CELL = re.compile(r"<td([^>]*)>(.*?)</td>", re.S | re.I)
_SPAN = r"{}\s*=\s*[\"']?(\d+)[\"']?"
BREAK = "<br/>"

#: Tables that a task gives out at once.
BATCH = 1_000
_MERGED = pa.schema([("doc_id", pa.int64()), ("island", pa.int64()), ("html", pa.string())])


@dataclass(eq=False)
class Cell:
    attrs: str
    text: str

    def span(self, name: str) -> int:
        found = re.search(_SPAN.format(name), self.attrs, re.I)
        return int(found[1]) if found else 1

    def widen(self, name: str, n: int) -> None:
        """Sets a span; one that is given already is replaced, also by 1, a new one is only written above 1."""
        given = re.compile(_SPAN.format(name), re.I)
        if given.search(self.attrs):
            self.attrs = given.sub(f'{name}="{n}"', self.attrs)
        elif n > 1:
            self.attrs = f'{self.attrs} {name}="{n}"'.strip()

    def add(self, text: str) -> None:
        self.text = BREAK.join(t for t in (self.text.strip(), text) if t)

    def markup(self) -> str:
        attrs = self.attrs.strip()
        return f"<td {attrs}>{self.text.strip()}</td>" if attrs else f"<td>{self.text.strip()}</td>"


def read_rows(html: str | None) -> list[list[Cell]]:
    return [[Cell(*c) for c in _CELL.findall(r)] for r in _ROW.findall(html or "")]


def write_rows(rows: list[list[Cell]]) -> str:
    return "<table>\n" + "\n".join("<tr>" + "".join(c.markup() for c in r) + "</tr>" for r in rows) + "\n</table>"


@dataclass
class Grid:
    """Which cells hold which columns of the row that comes next, and for how many rows."""

    held: dict[int, tuple[Cell, int]] = field(default_factory=dict)

    def put(self, row: list[Cell]) -> None:
        """The spans of a row's cells, each at its first free column."""
        at = 0
        for cell in row:
            while at in self.held:
                at += 1
            wide, high = cell.span("colspan"), cell.span("rowspan")
            if high > 1:
                for c in range(at, at + wide):
                    self.held[c] = (cell, high)
            at += wide

    def next(self) -> None:
        self.held = {c: (cell, n - 1) for c, (cell, n) in self.held.items() if n > 1}


def front(rows: list[list[Cell]]) -> list[tuple[Cell, bool]]:
    """The last row's columns in order: its own cells, and those that hold a place from above (true). A cell of the row
    itself that spans several rows is met twice, as a place that it holds and as itself."""
    grid = Grid()
    for row in rows[:-1]:
        grid.put(row)
        grid.next()
    own = iter(rows[-1])
    grid.put(rows[-1])
    out, at, last = [], 0, max(grid.held, default=-1)
    while True:
        if at in grid.held:
            cell, held = grid.held[at][0], True
        elif (cell := next(own, None)) is not None:
            held = False
        elif at < last:
            at += 1
            continue
        else:
            return out
        out.append((cell, held))
        at += cell.span("colspan")


def join_head(rows: list[list[Cell]], head: list[Cell]) -> list[Cell]:
    """Joins a page's first row to the last of rows where the page's end cut a row in two; changes rows. What is left of
    the head as a row of its own, all of it if nothing was joined.

    Cells are matched from the left while their colspans agree. Nothing is joined if every cell of the head has text.
    If a matched cell, from the first one with text on, says the same in both rows, only the blank ones before it are
    joined: those then span one more row. Otherwise all matched cells are. If no cell matches, single cells are joined.
    """
    tail = front(rows) if rows else []
    matched = 0
    while matched < min(len(tail), len(head)) and tail[matched][0].span("colspan") == head[matched].span("colspan"):
        matched += 1
    if not matched:
        own = [c for c, held in tail if not held]
        if len(own) == len(head) == 1 and head[0].text.strip():
            own[0].add(head[0].text.strip())
            return []
        return head
    if all(c.text.strip() for c in head):
        return head
    told = next((k for k in range(matched) if head[k].text.strip()), matched)
    same = any(head[k].text.strip() and head[k].text.strip() == tail[k][0].text.strip() for k in range(told, matched))
    joined = told if same else matched
    if not joined:
        return head
    whole = joined == len(head)
    high = [(cell, cell.span("rowspan"), cell.text) for cell, _ in tail]  # as they were before
    for k, (cell, held) in enumerate(tail[:matched]):
        more, text = head[k].span("rowspan"), head[k].text.strip()
        if k < joined:
            if held and any(cell is c for c in rows[-1]):
                continue  # it is joined where it stands as itself
            cell.widen("rowspan", high[k][1] + more - whole)
            cell.add(text)
        elif held and more > 1 and not text and not any(cell is c for c in rows[-1]):
            cell.widen("rowspan", high[k][1] + more)
    return [c for k, c in enumerate(head) if k >= joined and not (k < matched and tail[k][1] and not c.text.strip())]


def joined_parts(parts: list[list[list[Cell]]]) -> list[list[Cell]]:
    """The rows of a table's parts, one after the other; each part's first row is joined to the last row before it."""
    out: list[list[Cell]] = []
    for rows in parts:
        if out and rows:
            rest = join_head(out, rows[0])
            rows = [rest, *rows[1:]] if rest else rows[1:]
        out += rows
    return out


def shown(rows: list[list[Cell]]) -> list[int]:
    """Columns of each row: those held from above and its own."""
    grid, out = Grid(), []
    for row in rows:
        out.append(len(grid.held) + sum(c.span("colspan") for c in row))
        grid.put(row)
        grid.next()
    return out


def merged_table(parts: list[str | None], col_count: int | None = None, first: int = 5) -> str:
    """One table of a table's parts; a row of a single cell that is narrower than the table spans all of it."""
    rows = joined_parts([read_rows(p) for p in parts])
    wide = shown(rows)
    expected = max(wide[:first], default=0) or col_count or max(wide, default=0)
    for row, n in zip(rows, wide, strict=True):
        if len(row) == 1 and n < expected:
            row[0].widen("colspan", expected)
    return write_rows(rows)


def merged_tables(parts: DataFrame) -> DataFrame:
    """(doc_id, island, part_no, html, col_count) -> (doc_id, island, html): the parts of a run of tables as one, which
    is sequential in the parts of a run and independent between runs. Null markup has no rows.

    Runs are dealt by their key and stream through the tasks in order, so a batch holds many runs and a task one run's
    markup at a time."""
    ready(parts.sparkSession)
    cols = parts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("island").cast("long").alias("island"), "part_no", "html", F.col("col_count").cast("long").alias("col_count"))
    dealt = cols.repartition("doc_id", "island").sortWithinPartitions("doc_id", "island", "part_no")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(batch: pa.RecordBatch) -> Iterator[tuple]:
            return zip(*(batch.column(c).to_pylist() for c in ("doc_id", "island", "html", "col_count")), strict=True)

        done = []
        for (doc, island), rows in groupby((r for b in batches for r in told(b)), key=lambda r: r[:2]):
            own = list(rows)
            done.append({"doc_id": doc, "island": island, "html": merged_table([r[2] for r in own], own[0][3])})
            if len(done) == BATCH:
                yield pa.RecordBatch.from_pylist(done, schema=_MERGED)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_MERGED)

    return dealt.mapInArrow(fold, "doc_id long, island long, html string")
