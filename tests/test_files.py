"""Files of exact names and contents."""

import os

import pandas as pd
import pytest

from quire.sinks import files
from quire.sinks import text as sinks
from quire.sources import xlsx

ROWS = [("a.txt", "no end"), ("d/b c.txt", "é\n\n"), ("d/e/empty.txt", None), ("x.csv", files.MARK + "k\n")]


def found(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names}


def test_files_have_exact_names_and_bytes(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_files(spark.createDataFrame(ROWS, "name string, text string").repartition(3), path)
    want = {"a.txt": b"no end", "d/b c.txt": "é\n\n".encode(), "d/e/empty.txt": b"", "x.csv": b"\xef\xbb\xbfk\n"}
    assert found(path) == want and not any(n.startswith(".staging") for n in os.listdir(path))
    files.write_files(spark.createDataFrame([("a.txt", "new")], "name string, text string"), "file://" + path)
    assert found(path) == want | {"a.txt": b"new"}
    files.write_files(spark.createDataFrame([("b.txt", "only")], "name string, text string"), path, "overwrite")
    assert found(path) == {"b.txt": b"only"}
    files.write_files(spark.createDataFrame([], "name string, text string"), path)
    assert found(path) == {"b.txt": b"only"}


@pytest.mark.parametrize("name", ["../out.txt", "/etc/x", "", "d/", "d/../../x", None])
def test_of_a_failed_job_no_file_appears(spark, tmp_path, name):
    path = str(tmp_path / "out")
    with pytest.raises(Exception):
        files.write_files(spark.createDataFrame([*ROWS, (name, "x")], "name string, text string").repartition(2), path)
    # a task that still ran may leave what it staged
    assert [n for n in found(str(tmp_path)) if not n.startswith("out/.staging-")] == []


def test_csv_is_what_pandas_writes(spark):
    sheets = [("s", [["a", "b,c", None], ['q"q', "line\nend", " "], [], [None, "x", "1"]]), ("one", [["k"], [None], ["v"]])]
    rows = xlsx.read_sheets(spark.createDataFrame([("p", xlsx.workbook(sheets))], "path string, content binary"))
    got = {r["sheet_name"]: r["text"] for r in sinks.sheet_csv(rows).collect()}
    frame = pd.DataFrame([['q"q', "line\nend", " "], ["", "", ""], ["", "x", "1"]], columns=["a", "b,c", "Unnamed: 2"])
    assert got["s"] == files.MARK + frame.to_csv(index=False, lineterminator="\n")
    assert got["one"] == files.MARK + pd.DataFrame({"k": [None, "v"]}).to_csv(index=False, lineterminator="\n")


def test_parts_and_reports(spark):
    parts = spark.createDataFrame([(1, 5, 1, 3, "a.png", "<p>"), (1, 5, 2, 4, None, "<q>"), (1, 5, 3, 5, "c.png", "")], "doc_id int, table_id int, part_no int, page_no int, image string, html string")
    got = {r["name"]: r["text"] for r in sinks.part_results(parts).collect()}
    assert got == {"table_5_part1_page_3.txt": "跨页表格ID: 5 (第1/3部分)\n页码: 第3页\n原始图片: a.png\n" + sinks.RULE + "<p>", "table_5_part2_page_4.txt": "跨页表格ID: 5 (第2/3部分)\n页码: 第4页\n原始图片: \n" + sinks.RULE + "<q>"}
    t = spark.createDataFrame([(1, 2, 3, 3, 1, None, None, 0, None, None)], "doc_id int, table_id int, start_page int, end_page int, page_count int, merged_from array<int>, col_count int, row_count int, image string, html string")
    text = sinks.table_reports(t).first()["text"]
    assert text == "=" * 100 + "\nPDF表格识别结果\n" + "=" * 100 + "\n\n【表格 2】\n页码: 3\n类型: 单页表格\n图片: 无\n\n识别内容:\n" + "-" * 100 + "\n(识别失败)\n" + "-" * 100 + "\n\n"
