"""Workbooks (.xlsx) as rows: their sheets, what is in them, and their text.

Files come as Spark's binaryFile source gives them, (path, content), so they may lie in any store that Spark reads. A
workbook is read by one task, row by row; only the sheets that are asked for are parsed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.python import ready

# The number formats of dates, the first day, headings, and what stands for a sheet without rows.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
FIRST_DAY, FIRST_DAY_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
SHEET, EMPTY, UNNAMED = ("=== 工作表: ", " ==="), "(空工作表)", "Unnamed: "
#: Rows that a task gives out at once.
BATCH = 2_000
_SCHEMA = pa.schema([("path", pa.string()), ("sheet_no", pa.int32()), ("sheet_name", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _tree(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _text(item: ElementTree.Element) -> str:
    """The text of a string: its runs, without what tells how to pronounce it."""
    return "".join((e.text or "") if _local(e.tag) == "t" else _text(e) for e in item if _local(e.tag) in ("t", "r"))


def _dated(book: zipfile.ZipFile) -> list[bool]:
    """Whether cells of each style hold dates."""
    styles = _tree(book, "xl/styles.xml")
    if styles is None:
        return []
    own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if _local(e.tag) == "numFmt"}
    told = lambda n: n in DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, "")), re.I))
    formats = next((e for e in styles if _local(e.tag) == "cellXfs"), [])
    return [told(int(e.get("numFmtId", 0))) for e in formats]


def _column(ref: str | None, after: int) -> int:
    letters = re.match("[A-Z]+", ref or "")
    if not letters:
        return after
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


class Workbook:
    """The sheets of a workbook and their rows of text. Whole numbers have no decimals; dates are as ISO writes them."""

    def __init__(self, content: bytes):
        self.book = zipfile.ZipFile(io.BytesIO(content))
        root, links = _tree(self.book, "xl/workbook.xml"), _tree(self.book, "xl/_rels/workbook.xml.rels")
        if root is None or links is None:
            raise ValueError("no workbook")
        target = {e.get("Id"): e.get("Target", "") for e in links}
        own = [(e.get("name", ""), next((v for k, v in e.attrib.items() if _local(k) == "id"), "")) for e in root.iter() if _local(e.tag) == "sheet"]
        self.sheets = [(name, t.lstrip("/") if (t := target.get(link, "")).startswith("/") else f"xl/{t}") for name, link in own]
        strings = _tree(self.book, "xl/sharedStrings.xml")
        self.strings = [] if strings is None else [_text(e) for e in strings if _local(e.tag) == "si"]
        self.dated = _dated(self.book)
        self.first_day = FIRST_DAY_1904 if any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter()) else FIRST_DAY

    def value(self, cell: ElementTree.Element) -> str | None:
        kind, inner = cell.get("t", "n"), {_local(e.tag): e for e in cell}
        if kind == "inlineStr":
            return _text(inner["is"]) if "is" in inner else None
        raw = inner["v"].text if "v" in inner else None
        if raw is None or kind in ("str", "e"):
            return raw
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "b":
            return "True" if raw.strip() == "1" else "False"
        style = int(cell.get("s", 0))
        if style < len(self.dated) and self.dated[style]:
            return str(self.first_day + timedelta(seconds=round(float(raw) * 86_400)))
        number = float(raw)
        return str(int(number)) if number == int(number) else repr(number)

    def rows(self, place: str) -> Iterator[tuple[int, list[str | None]]]:
        """(number from 1, cells), without the blank rows at the end; rows that a sheet leaves out are not given."""
        number = 0
        with self.book.open(place) as f:
            for _, e in ElementTree.iterparse(f):
                if _local(e.tag) != "row":
                    continue
                number, cells = int(e.get("r", number + 1)), []
                for c in e:
                    at = _column(c.get("r"), len(cells))
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self.value(c)
                e.clear()
                if any(v not in (None, "") for v in cells):
                    yield number, cells


def read_sheets(files: DataFrame, sheets: Sequence[str] | None = None) -> DataFrame:
    """(path, content) -> (path, sheet_no, sheet_name, row_no, cells, error).

    For each sheet, or each of those named, a row with row_no 0 and no cells, and one for each of its rows that is not
    blank. A file that is none, or is broken, gives one row with an error; rows read before the break stay.
    """
    ready(files.sparkSession)
    wanted = None if sheets is None else set(sheets)

    def read(path: str, content: bytes | None) -> Iterator[dict]:
        try:
            book = Workbook(content or b"")
            for no, (name, place) in enumerate(book.sheets):
                if wanted is None or name in wanted:
                    own = {"path": path, "sheet_no": no, "sheet_name": name, "error": None}
                    yield own | {"row_no": 0, "cells": None}
                    for row_no, cells in book.rows(place):
                        yield own | {"row_no": row_no, "cells": cells}
        except Exception as e:  # a broken file is a row, whatever breaks
            yield {"path": path, "sheet_no": None, "sheet_name": None, "row_no": None, "cells": None, "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in read(path, content):
                    done.append(row)
                    if len(done) == BATCH:
                        yield pa.RecordBatch.from_pylist(done, schema=_SCHEMA)
                        done = []
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, "path string, sheet_no int, sheet_name string, row_no int, cells array<string>, error string")


def sheet_info(rows: DataFrame) -> DataFrame:
    """-> (path, sheet_no, sheet_name, n_rows, n_columns, column_names, is_empty): the first row names the columns; a blank
    name is Unnamed with its number, and one that stands before gets a number."""
    by = ["path", "sheet_no", "sheet_name"]
    own = rows.filter("error is null").groupBy(*by).agg(F.coalesce(F.max("row_no"), F.lit(0)).alias("last"), F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("n"), F.max(F.when(F.col("row_no") == 1, F.col("cells"))).alias("head"))
    wide = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    named = F.transform(wide, lambda k: F.coalesce(F.nullif(F.get("head", k), F.lit("")), F.concat(F.lit(UNNAMED), k.cast("string"))))
    own = own.withColumn("names", named)
    before = lambda v, k: F.size(F.filter(F.slice("names", 1, k), lambda w: w == v))
    names = F.transform("names", lambda v, k: F.when(before(v, k) > 0, F.concat(v, F.lit("."), before(v, k).cast("string"))).otherwise(v))
    return own.select(*by, F.greatest(F.col("last") - 1, F.lit(0)).alias("n_rows"), F.col("n").alias("n_columns"), names.alias("column_names"), (F.col("last") <= 1).alias("is_empty"))


def workbook_text(rows: DataFrame) -> DataFrame:
    """-> (path, text): each sheet under its heading as a table of columns that stand to the right, with the number of each
    row, and an empty line; a sheet without rows below its names says so. Blank cells are empty, blank rows between
    others are shown. Numbers stand as they are, not filled up to the decimals of their column.

    Widths are taken over columns first, so rows are only put together once they are text.
    """
    by = ["path", "sheet_no"]
    info = sheet_info(rows)
    data = rows.filter("row_no > 1").select(*by, (F.col("row_no") - 2).alias("n"), "cells")
    every = info.filter("n_rows > 0").select(*by, "n_columns", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("n")).join(data, [*by, "n"], "left")
    cells = data.select(*by, F.posexplode("cells").alias("k", "v")).groupBy(*by, "k").agg((F.max(F.length(F.coalesce("v", F.lit("")))) + 1).alias("wide"))
    wide = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "wide"))).alias("wide"))
    info = info.join(wide, by, "left")
    widths = F.transform("column_names", lambda v, k: F.greatest(F.length(v), F.coalesce(F.try_element_at("wide", k), F.lit(1))))
    info = info.withColumn("widths", widths).withColumn("left", F.length((F.col("n_rows") - 1).cast("string")))
    line = lambda n, of: F.concat(F.rpad(n, F.col("left"), F.lit(" ")), F.array_join(F.transform("widths", lambda w, k: F.concat(F.lit(" "), F.lpad(of(k), w, F.lit(" ")))), ""))
    head = info.filter("not is_empty").select(*by, F.lit(-1).alias("n"), line(F.lit(""), lambda k: F.get("column_names", k)).alias("text"))
    body = every.join(info.select(*by, "widths", "left"), by).select(*by, "n", line(F.col("n").cast("string"), lambda k: F.coalesce(F.get("cells", k), F.lit(""))).alias("text"))
    title = info.select(*by, F.lit(-2).alias("n"), F.concat(F.lit(SHEET[0]), "sheet_name", F.lit(SHEET[1]), F.when(F.col("is_empty"), f"\n{EMPTY}").otherwise("")).alias("text"))
    last = info.select(*by, F.lit(2**31 - 1).alias("n"), F.lit("").alias("text"))
    items = title.unionByName(head).unionByName(body).unionByName(last)
    ordered = F.sort_array(F.collect_list(F.struct("sheet_no", "n", "text")))
    return items.groupBy("path").agg(F.array_join(F.transform(ordered, lambda v: v["text"]), "\n").alias("text"))


def valid_workbooks(rows: DataFrame) -> DataFrame:
    """(path, valid): whether a file could be read and has a sheet."""
    return rows.groupBy("path").agg((F.count("error") == 0).alias("valid"))


def head_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of each sheet."""
    n = F.row_number().over(W.partitionBy("path", "sheet_no").orderBy("row_no"))
    return rows.filter("row_no > 0").withColumn("n", n).filter(F.col("n") <= most).drop("n")


def workbook(sheets: Sequence[tuple[str, Sequence[Sequence[str | int | float | None]]]]) -> bytes:
    """A workbook of named sheets of rows, texts shared."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    strings: dict[str, int] = {}
    safe = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        return f'<c t="s"><v>{strings.setdefault(v, len(strings))}</v></c>' if isinstance(v, str) else f"<c><v>{v!r}</v></c>"

    pages = ["".join(f'<row r="{k}">' + "".join(map(cell, row)) + "</row>" for k, row in enumerate(rows, 1)) for _, rows in sheets]
    files = {f"xl/worksheets/sheet{k}.xml": f'<worksheet xmlns="{main}"><sheetData>{page}</sheetData></worksheet>' for k, page in enumerate(pages, 1)}
    files["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{safe(name)}" sheetId="{k}" r:id="r{k}"/>' for k, (name, _) in enumerate(sheets, 1)) + "</sheets></workbook>"
    files["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>"
    files["xl/sharedStrings.xml"] = f'<sst xmlns="{main}">' + "".join(f'<si><t xml:space="preserve">{safe(t)}</t></si>' for t in strings) + "</sst>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()
