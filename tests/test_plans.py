"""What queries on cells shuffle: lines by their table, once for each time they are read, and nothing that is made of them."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.text import escape_html
from quire.operators import tables
from quire.plans import registry
from quire.sources import layout

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "times"), [("char_to_cell", 3), ("cell_text", 3), ("row_groups", 1), ("row_col_counts", 1), ("cell_grid", 1), ("html_tables", 1)])
def test_only_lines_are_shuffled(spark, monkeypatch, name, times):
    monkeypatch.setattr(layout, "LINES", 500)
    assert layout.cells(spark, D).rdd.getNumPartitions() >= 12
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        registry.queries()[name](spark, D).explain()
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", told.getvalue())) == told.getvalue().count("Exchange ") == times


def test_characters_in_far_and_missing_bands(spark):
    cells = spark.createDataFrame([("d", r, 0, 0.0, 10.0, y, y + 10) for r, y in enumerate((0.0, 20.0, 5000.0))], "doc_id string, row_index int, col_index int, x_start double, x_end double, y_start double, y_end double")
    at = [(1.0, 5.0), (15.0, 18.0), (5001.0, 5002.0), (900.0, 910.0), (12.0, 6000.0), (25.0, 20.0)]
    chars = spark.createDataFrame([("d", k, "x", 1.0, a, 2.0, b) for k, (a, b) in enumerate(at)], "doc_id string, char_no long, c string, x0 double, y0 double, x1 double, y1 double")
    got = {r["char_no"]: r["row_index"] for r in tables.char_to_cell(chars, cells).collect()}
    assert got == {0: 0, 2: 2, 4: 1, 5: 1}


def test_a_cell_is_in_each_near_row(spark):
    cells = spark.createDataFrame([("d", 0.0, y) for y in (0.0, 1.5, 3.0, 3.04, 9.0)], "doc_id string, x0 double, y0 double")
    got = sorted((r["y0"], r["row_index"]) for r in tables.row_groups(cells).collect())
    assert got == [(0.0, 0), (0.0, 1), (1.5, 0), (1.5, 1), (1.5, 2), (3.0, 1), (3.0, 2), (3.04, 1), (3.04, 2), (9.0, 3)]


def test_escapes_between_breaks(spark):
    texts = {"a<br>b": "a<br>b", "&lt;br&gt;": "&amp;lt;br&amp;gt;", "<<br>>": "&lt;<br>&gt;", '&"<br': "&amp;&quot;&lt;br", None: "", "<BR>": "&lt;BR&gt;"}
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", escape_html(F.col("x")).alias("e")).collect()
    assert {r["x"]: r["e"] for r in got} == texts
