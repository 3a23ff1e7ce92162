"""Characters in cells, told in numpy, beside plain loops."""

import contextlib
import io
import random

import numpy as np
import pyarrow as pa
import pytest

from quire.operators import placing, tables
from quire.plans import registry

D = "/root/testdata/sf0.001"
CELLS = "doc_id string, row_index int, col_index int, x_start double, x_end double, y_start double, y_end double"
CHARS = "doc_id string, char_no long, c string, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("name", ["char_to_cell", "cell_text"])
def test_no_expression_is_evaluated_cell_by_cell(spark, name):
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        registry.queries()[name](spark, D).explain()
    assert "lambdafunction(" not in told.getvalue() and "MapInArrow" in told.getvalue()


def test_a_box_from_below_meets_all_bands(spark):
    cells = spark.createDataFrame([("d", 0, 0, 0.0, 10.0, 60.0, 70.0), ("d", 1, 0, 0.0, 10.0, 115.0, 119.0)], CELLS)
    chars = spark.createDataFrame([("d", 0, "x", 1.0, 120.0, 2.0, 10.0), ("e", 1, "y", 1.0, 61.0, 2.0, 62.0), ("d", 2, "z", None, 61.0, 2.0, 62.0), (None, 3, "z", 1.0, 61.0, 2.0, 62.0)], CHARS)
    assert [(r["char_no"], r["row_index"]) for r in tables.char_to_cell(chars, cells).collect()] == [(0, 0)]


def brute(table, chars, of, cells):
    out = []
    for t, x0, y0, x1, y1 in zip(table, *chars, strict=True):
        own = [(k, c) for k, (s, c) in enumerate(zip(of, zip(*cells, strict=True), strict=True)) if s == t]
        over = [k for k, (xs, ys, xe, ye) in own if x0 < xe and x1 > xs and y0 < ye and y1 > ys]
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        centre = [k for k, (xs, ys, xe, ye) in own if xs <= mx <= xe and ys <= my <= ye]
        out.append((over or centre or [-1])[0])
    return out


@pytest.mark.parametrize("pairs", [7, 1_000_000])
def test_first_cells_equal_a_loop(monkeypatch, pairs):
    monkeypatch.setattr(placing, "PAIRS", pairs)
    r = np.random.default_rng(4)
    for high in (30, 300, 100_000):
        table = np.sort(r.integers(0, 5, 200))
        of = np.sort(r.choice([0, 1, 3, 4, 6], 60))
        x, y = r.integers(-20, 100, (2, 200)), r.integers(-high, high, 200)
        chars = [a.astype(float) for a in (x[0], y, x[0] + r.integers(-3, 9, 200), y + r.integers(-high // 4, high // 2, 200))]
        x, y = r.integers(-20, 100, 60), r.integers(-high, high, 60)
        cells = [a.astype(float) for a in (x, y, x + r.integers(-2, 60, 60), y + r.integers(-2, high // 2, 60))]
        got = placing.first_cells(table, chars, of, cells, 50.0).tolist()
        assert got == brute(table, chars, of, cells)
        assert -1 in got and max(got) > 0


def test_texts_equal_a_loop_however_batches_are_cut(monkeypatch):
    r = random.Random(4)
    rows = [(doc, n, r.choice(["a", "b", " ", "é", "<br>", None]), float(r.randrange(6)), r.randrange(40) / 4, doc % 2, r.randrange(2)) for doc in (1, 2, 3, 5, 8) for n in range(r.choice([1, 30, 80]))]
    want = {}
    for doc, n, c, x, y, row, col in rows:
        want.setdefault((doc, row, col), []).append((y, x + 1, n, c))
    for key, items in want.items():
        lines, anchor = [], None
        for y, x, n, c in sorted(items, key=lambda i: i[:3]):
            if anchor is None or y - anchor >= 2:
                anchor = y
                lines.append([])
            lines[-1].append((x, y, n, c))
        text = ""
        for k, line in enumerate(lines):
            for i, (_, _, _, c) in enumerate(sorted(line, key=lambda i: i[:3])):
                # a null character takes the break before it along
                text += "" if c is None else ("<br>" if k and not i else "") + c
        want[key] = text.strip()
    names = ["doc_id", "char_no", "c", "x0", "y0", "row_index", "col_index"]
    whole = pa.RecordBatch.from_pydict(dict(zip(names, map(pa.array, zip(*rows, strict=True)), strict=True)))
    whole = whole.append_column("x1", pa.array([x[3] + 2 for x in rows])).append_column("y1", pa.array([x[4] + 1 for x in rows]))
    for at_once, step in ((1, 1), (1, 7), (20, 7), (50_000, 1_000)):
        monkeypatch.setattr(placing, "ROWS", at_once)
        got = [t for b in placing.texts((whole.slice(k, step) for k in range(0, len(rows), step)), 2.0) for t in b.to_pylist()]
        assert len(got) == len(want) and {(t["doc_id"], t["row_index"], t["col_index"]): t["text"] for t in got} == want
