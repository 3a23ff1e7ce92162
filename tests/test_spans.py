"""Cells under spans, by hand-made tables and properties of random ones."""

import random

from quire.operators import spans

R2, R3, W2 = 'rowspan="2"', 'rowspan="3"', 'colspan="2"'


def table(*rows):
    return "<table>\n" + "\n".join("<tr>" + "".join(f"<td{' ' + a if a else ''}>{t}</td>" for a, t in row) + "</tr>" for row in rows) + "\n</table>"


def test_covered_cells_go():
    given = table([(R2, "k"), ("", " a ")], [("", "over"), ("", "b")], [("", "c"), ("", "d")])
    assert spans.without_covered(given) == table([(R2, "k"), ("", " a ")], [("", "b")], [("", "c"), ("", "d")])
    # a span over columns covers both; a row with nothing left stays
    wide = table([(f"{W2} {R2}", "k")], [("", "x"), ("", "y")])
    assert spans.without_covered(wide) == wide
    assert spans.without_covered("<table><tr></tr></table>") == "<table>\n<tr></tr>\n</table>" and spans.without_covered(None) == "<table>\n\n</table>"


def test_blank_spans_are_absorbed():
    given = table([(R2, "k"), ("", "a")], [("", "b")], [(R3, " "), ("", "c")], [("", "d")], [("", "e")])
    assert spans.absorbed(given) == table([('rowspan="5"', "k"), ("", "a")], [("", "b")], [("", "c")], [("", "d")], [("", "e")])
    # a cell with text of one row takes no blank span in; a blank cell over columns stays
    kept = table([("", "k"), ("", "a")], [(R2, ""), ("", "b")], [("", "c")])
    assert spans.absorbed(kept) == kept
    over = table([(R2, "k"), (R2, "l")], [], [(f"{W2} {R2}", "")], [])
    assert spans.absorbed(over) == over
    assert spans.absorbed(table([('rowspan="1" class="x"', "a")])) == table([('class="x"', "a")])


def test_columns_of_a_row():
    given = table([(R3, "k"), (W2, "a"), ("", "b")], [(R2, "c"), ("", "d"), ("", "e")], [(W2, "f")])
    got = spans.columns_of(given, 2)
    assert [(p.text, p.start_row, p.high) for p in got] == [("k", 0, 3), ("c", 1, 2), ("f", None, 1), ("", None, 1)]
    assert [p.text for p in spans.columns_of(given, 0)] == ["k", "a", "", "b"] and spans.columns_of(given, 3) == [] == spans.columns_of(None, 0)


def test_rewriting_twice_is_rewriting_once():
    rnd = random.Random(2)
    for _ in range(300):
        rows = [[(rnd.choice(["", "", R2, R3]), rnd.choice(["x", "y", " "])) for _ in range(rnd.randrange(1, 4))] for _ in range(rnd.randrange(1, 6))]
        once = spans.absorbed(table(*rows))
        assert spans.absorbed(once).count("<tr>") == len(rows)
        texts = lambda h: [c.text for _, row in spans.read(h) for c in row if c.text.strip()]
        assert texts(once) == texts(table(*rows))
        clean = spans.without_covered(table(*rows))
        assert set(texts(clean)) <= set(texts(table(*rows)))


def test_null_rows_in_spark(spark):
    df = spark.createDataFrame([(1, None, 0), (2, table([(R2, "k")], []), 1), (3, table([("", "a")]), None)], "doc_id long, html string, row_no int")
    assert {r["doc_id"]: r["html"] for r in spans.rewritten(df, spans.absorbed).collect()}[1] == "<table>\n\n</table>"
    assert [tuple(r) for r in spans.row_columns(df).collect()] == [(2, 0, "k", 0, 2)]
