import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions import text as txt
from quire.operators import assemble, images, markup, merge, rows, tables
from quire.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, same, name):
    same(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (txt.strip_edge_page_numbers, "3\n text\n4\n第 5 页", " text"),
        (txt.clean_text, "3\na\n7\nb", "a\nb"),
        (txt.remove_simple, "h1\nh2\n12\nbody\n\n", "body"),
        (txt.remove_simple, "a\nb\nc", "a\nb\nc"),
        (txt.collapse_blank_lines, "a\n \n\n\nb", "a\n \nb"),
        (txt.trim_py, "\t　a \n", "a"),
        (txt.escape_html, 'a<br>"b"<br/>&', "a<br>&quot;b&quot;&lt;br/&gt;&amp;"),
        (txt.strip_edge_page_numbers, "", ""),
        (txt.strip_edge_page_numbers, "1\n2", ""),
    ],
)
def test_text_rules(spark, f, given, expected):
    assert one(spark, given, f) == expected


def test_splitlines_is_python_s(spark):
    for s in ("", "a", "a\n", "\n", "a\r\nb\rc\x0bd\u2028e", "a\n\n"):
        assert one(spark, s, txt.splitlines_py) == s.splitlines()


def test_pages_last_marker_wins(spark):
    got = one(spark, "x==第1页==\nA\n==第2页==\nB\n==第1页==C", txt.split_pages)
    assert {(r["page_no"], r["text"]) for r in got} == {(1, "C"), (2, "B")}


def test_merge_coords_drifts(spark):
    assert one(spark, [10.0, 11.0, 12.5, 20.0], lambda x: geo.merge_coords(x, 2.0), "array<double>") == [10.5, 12.5, 20.0]
    assert one(spark, [], lambda x: geo.merge_coords(x, 2.0), "array<double>") == []


def test_overlap_and_validity(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0)], "x0 double, y0 double, x1 double, y1 double, a0 double, a1 double, a2 double, a3 double")
    assert df.select(geo.overlap_ratio(geo.box(), [F.col(f"a{k}") for k in range(4)])).first()[0] == 0.25
    for width, ok in ((401.0, False), (400.0, True)):
        t = spark.createDataFrame([(0.0, 0.0, width, 30.0, 1, 2)], "x0 double, y0 double, x1 double, y1 double, row_count int, col_count int")
        assert (tables.valid_tables(t, True).count() == 1) is ok


def test_cell_text_has_lines_by_anchor(spark):
    # lines of a cell overlap in x; y0 drifts: 0, 1.5 and 3.0 are two lines, as 3.0 is measured from the first
    rows = [(1, 0, "b", 20.0, 1.5), (1, 1, "a", 10.0, 0.0), (1, 2, "c", 5.0, 3.0), (1, 3, "e", 15.0, 9.0), (1, 4, "d", 12.0, 10.9), (1, 5, " ", 0.0, 0.5), (2, 6, "x", 0.0, 0.0)]
    placed = spark.createDataFrame([(1, n, c, x, y, x + 4, y + 4, 0, col) for col, n, c, x, y in rows], "doc_id long, char_no long, c string, x0 double, y0 double, x1 double, y1 double, row_index int, col_index int")
    assert {r["col_index"]: r["text"] for r in tables.cell_text(placed).collect()} == {1: "ab<br>c<br>de", 2: "x"}


def test_cell_text_has_every_character(spark):
    from quire.sources import layout

    want = {(r["doc_id"], r["row_index"], r["col_index"]): r["text"] for r in layout.cells(spark, SF).collect()}
    got = {(r["doc_id"], r["row_index"], r["col_index"]): r["text"].replace("<br>", "") for r in registry.queries()["cell_text"](spark, SF).collect()}
    assert got == want and max(map(len, want.values())) > 1


def test_display_columns(spark):
    rows = [[(1, 2), (2, 1)], [(1, 1), (1, 1)], [(1, 1)]]
    df = spark.createDataFrame([(1, r, c, *span) for r, row in enumerate(rows) for c, span in enumerate(row)], "doc_id int, row_no int, cell_no int, colspan int, rowspan int")
    assert [r["cols"] for r in tables.display_columns(df).orderBy("row_no").collect()] == [3, 3, 1]


def td(text, attrs=""):
    return f"<td {attrs}>{text}</td>" if attrs else f"<td>{text}</td>"


def table_of(*row):
    return "<table>\n" + "\n".join(f"<tr>{r}</tr>" for r in row) + "\n</table>"


TWO, WIDE = 'rowspan="2"', 'colspan="2"'


@pytest.mark.parametrize(
    ("tail", "head", "expected"),
    [
        ([td(1) + td("A")], td(2) + td("B"), [td(1) + td("A"), td(2) + td("B")]),
        ([td(1) + td("A")], td(" ") + td("B"), [td(1) + td("A<br/>B")]),
        ([td(1) + td("A") + td("x")], td("") + td("A") + td("y"), [td(1, TWO) + td("A") + td("x"), td("A") + td("y")]),
        ([td("T", WIDE)], td("h"), [td("T<br/>h", WIDE)]),
        ([td(1) + td("A", WIDE)], td("") + td("b") + td("c"), [td(1, TWO) + td("A", WIDE), td("b") + td("c")]),
        ([td("G", TWO) + td("a"), td("b")], td("") + td("c"), [td("G", TWO) + td("a"), td("b<br/>c")]),
        ([td("T")], td("h"), [td("T"), td("h")]),
    ],
)
def test_rows_joined_over_pages(tail, head, expected):
    got = rows.write_rows(rows.joined_parts([rows.read_rows(table_of(*tail)), rows.read_rows(table_of(head))]))
    assert got == table_of(*expected)


def test_merged_tables(spark):
    parts = [(1, 1, 1, table_of(td("") + td("B"), td("end")), 2), (1, 1, 0, table_of(td("h") + td("h2"), td(1) + td("A")), 2), (2, 1, 0, None, None)]
    df = spark.createDataFrame(parts, "doc_id long, island long, part_no int, html string, col_count int")
    got = {r["doc_id"]: r["html"] for r in rows.merged_tables(df).collect()}
    assert got == {1: table_of(td("h") + td("h2"), td(1) + td("A<br/>B"), td("end", WIDE)), 2: "<table>\n\n</table>"}


def test_html_grid_with_spans(spark):
    cells = [(0, 0, 0.0, 0.0, 50.0, 40.0, "G"), (0, 1, 50.0, 0.0, 100.0, 20.0, 'a<br>"'), (1, 0, 50.0, 20.0, 100.0, 40.0, None)]
    df = spark.createDataFrame([(1, *c) for c in cells], "doc_id long, row_index int, col_index int, x_start double, y_start double, x_end double, y_end double, text string")
    expected = ["<table>", "  <tr>", '    <td rowspan="2">G</td>', "    <td>a<br>&quot;</td>", "  </tr>", "  <tr>", "    <td></td>", "  </tr>", "</table>"]
    assert markup.html_tables(df).first()["html"].split("\n") == expected
    shared = spark.createDataFrame([(1, [0.0, 25.0, 50.0, 100.0])], "doc_id long, xs array<double>")
    assert '<td colspan="2" rowspan="2">G</td>' in markup.html_tables(df, shared).first()["html"]
    assert markup.html_tables(df.limit(0)).collect() == []


def assembled(spark, pages, lines, tables=(), parts=(), seen=(), repeated=None):
    box = "x0 double, y0 double, x1 double, y1 double"
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    known = None if repeated is None else df([("d", r) for r in repeated], "doc_id string, text string")
    lines = [("d", page, no, text, 50.0, float(y), 60.0, float(y) + 8) for no, (page, y, text) in enumerate(lines)]
    return assemble.assembled(
        df([("d", *p) for p in pages], "doc_id string, page_no int, text string"), df(lines, f"doc_id string, page_no int, line_no int, text string, {box}"),
        df([("d", *r) for r in tables], f"doc_id string, table_id int, start_page int, end_page int, {box}, html string"), df([("d", *r) for r in parts], f"doc_id string, table_id int, page_no int, {box}"),
        df([("d", *r) for r in seen], "doc_id string, page_no int, img_no int, y0 double, text string"), known,
    ).first()["text"]


def test_covered_pages_without_text_are_left_out(spark):
    tables = [(1, 1, 2, 40.0, 500.0, 500.0, 800.0, "<table></table>")]
    got = assembled(spark, [(1, "x"), (2, "cell"), (3, "y\n3")], [(1, 20, "x"), (2, 20, "cell"), (3, 20, "y")], tables, [(1, 2, 40.0, 10.0, 500.0, 100.0)], [(3, 1, 10.0, "seen")])
    assert got == "第 1 页\n\nx\n\n表格（第1-2页）\n\n<table></table>\n\n\n第 3 页\n\nseen\n\ny\n\n"


def test_text_around_a_table_is_one_element(spark):
    table = (1, 1, 1, 40.0, 100.0, 500.0, 200.0, None)
    lines = [(1, 10, "Head"), (1, 30, "a"), (1, 50, "b"), (1, 150, "cell"), (1, 300, "c"), (1, 320, "12"), (1, 340, "d")]
    got = assembled(spark, [(1, "all"), (2, "Head\np\n2")], lines, [table], repeated=["Head"])
    assert got == "第 1 页\n\na\nb\n\n表格（第1页）\n\n(未能识别)\n\nc\nd\n\n\n第 2 页\n\np\n\n"


def test_text_between_two_tables_stands_between_them(spark):
    tables = [(2, 1, 1, 40.0, 300.0, 500.0, 400.0, "<t2>"), (1, 1, 1, 40.0, 100.0, 500.0, 200.0, "<t1>")]
    lines = [(1, 30, "a"), (1, 210, "b"), (1, 250, "c"), (1, 398, "beside"), (1, 500, "d"), (1, 150, "in")]
    got = assembled(spark, [(1, None)], lines, tables, seen=[(1, 1, 1.0, "seen"), (1, 2, 0.5, " "), (1, 3, 0.5, "first")])
    assert got == "第 1 页\n\na\n\n表格（第1页）\n\n<t1>\n\nb\nc\n\n表格（第1页）\n\n<t2>\n\nd\n\nfirst\n\nseen\n\n"


def test_a_covered_page_shows_what_is_its_own(spark):
    # page 2: the run's part above, a table of its own below, text between; page 3: an image only
    tables = [(1, 1, 3, 40.0, 500.0, 500.0, 800.0, "<run>"), (2, 2, 2, 40.0, 400.0, 500.0, 500.0, "<own>")]
    parts = [(1, 2, 40.0, 10.0, 500.0, 100.0), (1, 3, 40.0, 10.0, 500.0, 100.0)]
    lines = [(1, 20, "x"), (2, 20, "cell"), (2, 200, "mid"), (2, 600, "end"), (3, 30, "cell")]
    got = assembled(spark, [(1, "x"), (2, "p"), (3, "q")], lines, tables, parts, [(3, 1, None, "seen")])
    assert got == "第 1 页\n\nx\n\n表格（第1-3页）\n\n<run>\n\n\n第 2 页\n\nmid\n\n表格（第2页）\n\n<own>\n\nend\n\n\n第 3 页\n\nseen\n\n"
    # without text outside tables the page goes, its own table too
    assert "<own>" not in assembled(spark, [(1, "x"), (2, "p")], lines[:2], tables, parts)


def test_single_page_drops_every_image(spark):
    i = spark.createDataFrame([("d", 1, 100, 100, 1)], "doc_id string, img_no int, width int, height int, page_no int")
    assert images.size_filter(i, spark.createDataFrame([("d", 1)], "doc_id string, pages int")).count() == 0


def test_cells_of_markup(spark):
    got = one(spark, '<tr><td colspan="2">a</td><TD rowspan=3>b\nc</TD></tr>', txt.cells_of)
    assert [(r["content"], r["colspan"], r["rowspan"]) for r in got] == [("a", 2, 1), ("b\nc", 1, 3)]


def test_merge_of_empty_page(spark):
    pages = spark.createDataFrame([(1, 1, " "), (1, 2, None)], "doc_id int, page_no int, text string")
    ocr = spark.createDataFrame([(1, 1, 1, 9.0, "b.png", "a seen"), (1, 1, 2, 3.0, "a.png", "z above")], "doc_id int, page_no int, img_no int, y0 double, name string, text string")
    got = {k: [r["t"] for r in merge.joined(pages, ocr).select("page_no", merge.merged(k).alias("t")).orderBy("page_no").collect()] for k in ("append", "replace", "interleave")}
    items = "\n[图片: a.png]\nz above\n\n[图片: b.png]\na seen\n"
    assert got["replace"] == ["==第1页==\n[使用图片OCR结果]\n" + items, "==第2页==\n\n"]
    assert got["append"] == ["==第1页==\n\n[图片OCR结果]\n" + items, "==第2页==\n"] and got["interleave"] == ["==第1页==\n" + items, "==第2页==\n"]


def test_simple_removal_follows_its_parameters(spark):
    assert one(spark, "a\nb\nc\nd", lambda x: txt.remove_simple(x, header_lines=3)) == "a\nb\nc\nd" and one(spark, "a\nb\nc", lambda x: txt.remove_simple(x, header_lines=1)) == "b\nc"


def test_stamps_without_vectors(spark):
    v = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, None), ("b", 1, None), ("b", 2, None)] + [("c", k, [1.0]) for k in range(9)], "doc_id string, ord int, v array<double>")
    pairs = spark.createDataFrame([("c", k, k + 1) for k in range(8)], "doc_id string, a int, b int")
    got = {(r["doc_id"], r["ord"]): r["grp"] for r in images.stamp_groups(v, pairs).collect()}
    assert got == {("a", 1): 1, ("b", 1): 1, ("b", 2): 2} | {("c", k): 0 for k in range(9)}


def test_result_files(spark, tmp_path):
    from quire.sinks import text as files

    ocr = spark.createDataFrame([(1, 2, 1, "b.c.png", "second\nline"), (1, 1, 2, None, "first"), (1, 1, 1, "x.png", " \n"), (1, 3, 1, ".png", "third"), (2, 1, 1, "a.png", None)], "doc_id int, page_no int, img_no int, name string, text string")
    made = files.image_results(ocr)
    got = {r["file_no"]: (r["name"], r["text"]) for r in made.collect()}
    assert [got[k][0] for k in (1, 2, 3)] == ["image_1_page_1_image_1.txt", "image_2_page_2_b.c.txt", "image_3_page_3_.png.txt"] and len(got) == 3
    assert got[2][1] == "图片序号: 2\n页码: 第2页\n原始图片: b.c.png\n" + "=" * 80 + "\n\nsecond\nline"
    files.write_texts(made, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"), wholetext=True)
    assert {(r["name"], r["value"]) for r in back.collect()} == {(name, t + "\n") for name, t in got.values()}
    tables = spark.createDataFrame([(1, 3, 2, 4, None, "<table></table>"), (1, 4, 2, 4, 1, None)], "doc_id int, table_id int, page_no int, col_count int, row_count int, html string")
    rows = files.table_results(tables).collect()
    assert [r["name"] for r in rows] == ["table_3_page_2.txt"] and rows[0]["text"] == "表格ID: 3\n页码: 第2页\n类型: 单页表格\n列数: 4\n行数: 0\n" + "=" * 80 + "\n\n<table></table>"
    name = spark.range(1).select(files.final_name(F.lit("a"), F.lit("20240101")).alias("n")).first()["n"]
    assert name == "a_完整解析含表格_20240101.txt"
