"""Tables from drawings, by hand-made pages."""

import contextlib
import io

from quire.operators import lattice
from quire.plans import registry
from quire.sources import layout

SCHEMA = "doc_id string, page_no int, drawing_no long, type string, x0 double, y0 double, x1 double, y1 double, items array<struct<op:string,x0:double,y0:double,x1:double,y1:double>>"


def drawn(spark, *pages, kind="s"):
    rows = [("d", p, n, kind, *line[1:], [tuple(map(lambda v: v if isinstance(v, str) else float(v), line))]) for p, lines in enumerate(pages) for n, line in enumerate(lines)]
    return spark.createDataFrame([tuple(float(v) if isinstance(v, int) and k > 3 else v for k, v in enumerate(r)) for r in rows], SCHEMA)


def flat(y, x0, x1):
    return ("l", x0, y, x1, y)


def upright(x, y0, y1):
    return ("l", x, y0, x, y1)


def boxes(df, *more):
    return sorted(tuple(r[c] for c in (*more, "x0", "y0", "x1", "y1")) for r in df.collect())


def test_lattice_with_a_merged_cell(spark):
    # first row is one cell; lines end 2 short of each other, one line is drawn in two pieces, a short one stands alone
    page = [flat(0, 0, 100), flat(20, 2, 45), flat(20, 49, 100), flat(41, 0, 100), upright(0, 0, 40), upright(50, 22, 40), upright(100, 0, 40), flat(300, 10, 12)]
    lone = [flat(0, 0, 50), flat(20, 0, 50), upright(0, 0, 20), upright(50, 0, 20)]
    two = [*page, *[("l", x0, y0 + 200, x1, y1 + 200) for _, x0, y0, x1, y1 in lone], upright(25, 200, 220)]
    cells = lattice.lattice_cells(drawn(spark, page, lone, two, []))
    first = [(1, 0.0, 0.0, 100.0, 20.0), (1, 0.0, 20.0, 50.0, 41.0), (1, 50.0, 20.0, 100.0, 41.0)]
    assert boxes(cells.filter("page_no = 0"), "table_no") == first and cells.filter("page_no in (1, 3)").count() == 0
    assert boxes(cells.filter("page_no = 2"), "table_no") == [*first, (2, 0.0, 200.0, 25.0, 220.0), (2, 25.0, 200.0, 50.0, 220.0)]
    t = {r["table_no"]: r for r in lattice.lattice_tables(cells.filter("page_no = 2")).collect()}
    assert (t[1]["row_count"], t[1]["col_count"], t[1]["n_cells"], t[2]["row_count"], t[2]["y0"]) == (2, 2, 3, 1, 200.0)
    assert lattice.lattice_cells(drawn(spark, lone), least_cells=1).count() == 1


def test_border_lines_keep_their_first_place(spark):
    # 0, 1.5 and 3.0: the third is measured from the first and is a border of its own
    page = [flat(1.5, 0, 60), flat(0, 10, 50), flat(3, 5, 20), ("re", 10, 40, 90, 80), ("l", 0, 0, 30, 30)]
    got = lattice.border_lines(lattice.segments(drawn(spark, page)))
    assert sorted((r["flat"], r["at"], r["low"], r["high"]) for r in got.collect()) == [(False, 10.0, 40.0, 80.0), (False, 90.0, 40.0, 80.0), (True, 0.0, 0.0, 60.0), (True, 3.0, 5.0, 20.0), (True, 40.0, 10.0, 90.0), (True, 80.0, 10.0, 90.0)]
    grid = lattice.border_grid(got).collect()
    assert sorted((r["row_index"], r["col_index"], r["y_start"], r["y_end"]) for r in grid) == [(0, 0, 0.0, 3.0), (1, 0, 3.0, 40.0), (2, 0, 40.0, 80.0)]
    assert lattice.border_grid(lattice.border_lines(lattice.segments(drawn(spark, [flat(0, 0, 9)])))).count() == 0


def test_boxes_of_strokes(spark):
    box = [flat(100, 0, 80), flat(140, 0, 80), upright(0, 100, 140), upright(80, 100, 140)]
    near = [flat(103, 1, 81), *box]  # the first top wins
    loose = [flat(100, 0, 80), flat(140, 5, 85), upright(2, 104, 136), upright(82, 100, 140)]
    bare = [flat(100, 0, 80), flat(140, 0, 80), upright(0, 100, 140), upright(80, 100, 134)]
    small = [flat(100, 0, 50), flat(140, 0, 50), upright(0, 100, 140), upright(50, 100, 140)]
    got = lattice.stroke_boxes(drawn(spark, box, near, loose, bare, small, box[::-1], []))
    assert boxes(got, "page_no") == [(0, 0.0, 100.0, 80.0, 140.0), (1, 1.0, 103.0, 81.0, 140.0), (2, 0.0, 100.0, 80.0, 140.0), (5, 0.0, 100.0, 80.0, 140.0)]
    assert lattice.stroke_boxes(drawn(spark, box, kind="f")).count() == 0


def test_no_plan_pairs_all_with_all(spark):
    for name in ("rectangles_from_strokes", "grid_from_borders", "lattice_cells"):
        told = io.StringIO()
        with contextlib.redirect_stdout(told):
            registry.queries()[name](spark, "/root/testdata/sf0.001").explain()
        assert "NestedLoop" not in told.getvalue() and "Cartesian" not in told.getvalue()


def test_drawings_stay_in_tasks_of_bounded_size(spark, monkeypatch):
    # strokes are many more than the orders by which Spark tells sizes, so none may be broadcast, and orders are dealt by number
    monkeypatch.setattr(layout, "ORDERS", 100)
    assert layout.drawings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 15
    for name in ("rectangles_from_strokes", "border_lines", "lattice_cells", "lattice_tables"):
        told = io.StringIO()
        with contextlib.redirect_stdout(told):
            registry.queries()[name](spark, "/root/testdata/sf0.001").explain()
        assert "Broadcast" not in told.getvalue() and told.getvalue().count("Exchange") == 1
