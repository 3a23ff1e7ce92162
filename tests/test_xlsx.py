"""Workbooks against what pandas prints, and broken or odd ones."""

import io
import zipfile

import pandas as pd

from quire.sources import xlsx

SHEETS = [("data", [["name", "n", None, "n"], ["a & <b>", 1, None, "x"], [None, 22, 0.5, None], [], ["é", -3, "", "yy"]]), ("only names", [["a", "b"]]), ("nothing", [])]
FILES = "path string, content binary"


def test_round_trip_and_info(spark):
    rows = xlsx.read_sheets(spark.createDataFrame([("p", xlsx.workbook(SHEETS))], FILES)).cache()
    got = {(r["sheet_name"], r["row_no"]): r["cells"] for r in rows.collect()}
    assert got[("data", 2)] == ["a & <b>", "1", None, "x"] and got[("data", 3)] == [None, "22", "0.5", None] and got[("data", 5)] == ["é", "-3", "", "yy"]
    assert ("data", 4) not in got and got[("nothing", 0)] is None and len(got) == 8
    info = {r["sheet_name"]: r for r in xlsx.sheet_info(rows).collect()}
    assert (info["data"]["n_rows"], info["data"]["column_names"]) == (4, ["name", "n", "Unnamed: 2", "n.1"])
    assert info["only names"]["is_empty"] and info["nothing"]["n_columns"] == 0 and not info["data"]["is_empty"]
    assert xlsx.head_rows(rows, 1).count() == 2 and xlsx.read_sheets(spark.createDataFrame([("p", xlsx.workbook(SHEETS))], FILES), ["only names"]).count() == 2


def test_text_is_what_pandas_prints(spark):
    text = xlsx.workbook_text(xlsx.read_sheets(spark.createDataFrame([("p", xlsx.workbook(SHEETS))], FILES))).first()["text"]
    frame = pd.DataFrame([["a & <b>", "1", "", "x"], ["", "22", "0.5", ""], ["", "", "", ""], ["é", "-3", "", "yy"]], columns=["name", "n", "Unnamed: 2", "n.1"])
    assert text == f"=== 工作表: data ===\n{frame.to_string(index=True, header=True, na_rep='')}\n\n=== 工作表: only names ===\n(空工作表)\n\n=== 工作表: nothing ===\n(空工作表)\n"


def test_broken_files_are_rows(spark):
    odd = io.BytesIO()
    with zipfile.ZipFile(odd, "w") as z:
        z.writestr("a.txt", "x")
    rows = xlsx.read_sheets(spark.createDataFrame([("a", b"no zip"), ("b", None), ("c", odd.getvalue()), ("d", xlsx.workbook(SHEETS))], FILES)).cache()
    assert {r["path"]: r["valid"] for r in xlsx.valid_workbooks(rows).collect()} == {"a": False, "b": False, "c": False, "d": True}
    assert {r["path"] for r in rows.filter("error is not null").collect()} == {"a", "b", "c"}


def test_kinds_of_cells():
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = '<row r="2"><c r="B2" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r><rPh><t>no</t></rPh></is></c><c r="D2" t="b"><v>1</v></c><c t="str"><v>f</v></c><c r="AA2" s="1"><v>45000.5</v></c><c s="2"><v>2</v></c><c t="e"><v>#N/A</v></c><c t="s"/></row>'
    made = io.BytesIO(xlsx.workbook([("s", [])]))
    with zipfile.ZipFile(made, "a") as z:
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}<row/></sheetData></worksheet>')
    book = xlsx.Workbook(made.getvalue())
    [(number, row)] = list(book.rows("xl/worksheets/other.xml"))
    assert number == 2 and row[:5] == [None, "inline", None, "True", "f"] and row[26:] == ["2023-03-15 12:00:00", "2", "#N/A", None]
