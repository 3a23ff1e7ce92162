"""Rows cut by a page's end, judged by their key column: a case for each rule."""

import pytest

from quire.operators import row_merge


def tr(*cells):
    return "<tr>" + "".join(c if c.startswith("<td") else f"<td>{c}</td>" for c in cells) + "</tr>"


def td(attrs, text=""):
    return f"<td {attrs}>{text}</td>"


R2, R3, W2 = 'rowspan="2"', 'rowspan="3"', 'colspan="2"'
LONG, LATER = "n" * 50, "m" * 50
CASES = [
    ("no cells", "<tr></tr>", tr("a"), None, None, None, None),
    ("single cells", tr("a"), tr(td(W2, " b ")), None, None, tr(td(W2, "a<br/>b")), None),
    ("single cells", tr(td(R2, "a")), tr("b"), None, None, tr("a<br/>b"), None),
    ("other cells", tr("a"), tr(" "), None, None, None, None),
    ("blank cells in front", tr("k", td(R2, "b"), "c"), tr("", td(R2), "x", "y"), None, None, tr(td('rowspan="1"', "k"), td(R3, "b"), "c"), tr("x", "y")),
    ("blank cells in front", tr("a", "b", "c"), tr("", " "), None, None, tr(td('rowspan="1"', "a"), td('rowspan="1"', "b"), "c"), None),
    ("other cells", tr("a", "b"), tr("x", "", ""), None, None, None, None),
    ("blank cells, then a value again", tr("k", "a", "b"), tr(td(R2), "a", "z"), None, None, tr(td('rowspan="4"', "k"), "a", "b"), tr("a", "z")),
    ("blank cells", tr("k", "a", td(R2, "b")), tr("", "x", "y"), None, None, tr(td('rowspan="1"', "k"), td('rowspan="1"', "a<br/>x"), td(R2, "b<br/>y")), None),
    ("blank cells", tr("k", "a", "b"), tr("", "x", ""), None, None, tr(td('rowspan="1"', "k"), td('rowspan="1"', "b"), td('rowspan="1"', "b")), None),
    ("another key", tr("k", "a"), tr("l", "b"), None, None, None, None),
    ("another key", tr("", "a"), tr("l", "b"), None, None, None, None),
    ("blank spans and a value again", tr("k", "a", "b"), tr(td(f"{W2} {R2}"), "a", "z"), True, None, tr(td(f"{W2} {R2}", "k"), "a", "b"), tr("a", "z")),
    ("a value again after blank cells", tr("k", "a", "b"), tr(td(W2), "a", "z"), False, None, tr(td('rowspan="1"', "k"), "a", "b"), tr("a", "z")),
    ("a value again", tr("k", "a"), tr("k", "b"), None, None, None, None),
    ("a value under a blank cell", tr("k", "", "c"), tr(td(W2), "x", "y"), None, None, None, None),
    ("goes on below its key", tr("k", "a", "c"), tr(td(W2), "b", "d"), None, None, tr(td(W2, "k"), "ab", "c<br/>d"), None),
    ("goes on below its key", tr("k", LONG, td(R2)), tr(td(W2), LATER, ""), True, None, tr(td(W2, "k"), f"{LONG}<br/>{LATER}", td(R2)), None),
    ("goes on, then a new row", tr("", "a"), tr(td(W2), "b"), True, True, None, None),
    ("goes on, then a new row", tr("", "a"), tr(td(W2), ""), True, None, None, None),
    ("goes on without a key", tr(td(R2), "a", "c"), tr(td(W2), "b", td(R3)), True, None, tr(td(R2), "ab", td(R3)), None),
    ("never a key", tr("", "a"), tr(td(W2), "b"), None, None, None, None),
    ("few columns in common", tr("k", "a", "b", "c"), tr(td(W2), "x", "", ""), False, None, tr(td(W2, "k"), "a<br/>x", "b", "c"), None),
    ("otherwise", tr("k", "a"), tr(td(W2), ""), None, None, None, None),
]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(n, *c[1:5]) for n, c in enumerate(CASES)] + [(99, None, None, None, None)], "id int, tail string, head string, key boolean, next_row_whole boolean")
    return {r["id"]: r for r in row_merge.merged_rows(df).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_each_rule(judged, n):
    rule, tail, _, _, _, row, rest = CASES[n]
    got = judged[n]
    assert (got["rule"], got["merged"], got["row"], got["next_row"]) == (rule, row is not None, row if row is not None else tail, rest)


def test_null_rows(judged):
    assert (judged[99]["rule"], judged[99]["merged"], judged[99]["row"]) == ("no cells", False, None)


def test_two_rows_alone(spark):
    df = spark.createDataFrame([(tr("k", "a"), tr(td(W2), "b")), (tr("", "a"), tr(td(W2), "b"))], "tail string, head string")
    assert [r["rule"] for r in row_merge.merged_two_rows(df).collect()] == ["goes on below its key", "never a key"]
