"""Whether the last row of a page's table and the first row of the next page's are one row: the key-column rules, as an
expression over the two rows' cells. (rows.py joins rows by the structure of the whole table.)"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cells_of, trim_py

# What joins the halves of a cell, what a row span looks like, the column that is joined without a break if
# one half is shorter than NAME_CHARS, and the share of common columns below which rows complete each other.
BREAK, SPAN = "<br/>", r"(?i)rowspan\s*=\s*[\"']?\d+[\"']?"
NAME_COLUMN, NAME_CHARS, FEW_IN_COMMON = 1, 50, 0.3


def cell(attrs: Column, text: Column) -> Column:
    own = trim_py(attrs)
    return F.concat(F.when(own == "", "<td").otherwise(F.concat(F.lit("<td "), own)), F.lit(">"), text, F.lit("</td>"))


def with_span(attrs: Column, n: Column) -> Column:
    """Attributes with a row span of n, which replaces the one that is given."""
    span = F.concat(F.lit('rowspan="'), n.cast("string"), F.lit('"'))
    return F.when(attrs.rlike(SPAN), F.regexp_replace(attrs, F.lit(SPAN), span)).otherwise(trim_py(F.concat(attrs, F.lit(" "), span)))


def either(a: Column, b: Column) -> Column:
    return F.when(trim_py(a) != "", a).otherwise(b)


def told(c: Column) -> Column:
    return c["content"] != ""


def kept(c: Column) -> Column:
    return cell(c["attrs"], c["content"])


def spanning(t: Column, h: Column, more: Column | int = 0) -> Column:
    """The tail's cell, which also stands for a blank one of the head."""
    return cell(with_span(t["attrs"], t["rowspan"] + h["rowspan"] - 1 + more), t["content"])


def both(t: Column, h: Column, apart: Column | None = None) -> Column:
    """The texts of two cells; with a break between two that are not blank, unless `apart` is false."""
    gap = F.lit(BREAK) if apart is None else F.when(apart, BREAK).otherwise("")
    return F.when(told(t) & told(h), F.concat(t["content"], gap, h["content"])).when(told(t), t["content"]).otherwise(h["content"])


def row_of(cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>"))


def has_key(row: Column) -> Column:
    """Whether the first cell of a row is not blank; false without cells."""
    return F.coalesce(trim_py(F.get(cells_of(row), F.lit(0))["content"]) != "", F.lit(False))


@dataclass(frozen=True)
class Rule:
    """A rule's name, when it holds, and the row and the row after it that it makes; no row leaves both rows as they are."""

    name: str
    holds: Column
    row: Column | None = None
    rest: Column | None = None


def _filled(t: Column, h: Column, k: Column, keyed: bool, keeps: bool) -> Column:
    """A cell of two rows that complete each other. keyed: halves of the name column are joined without a break; keeps: a
    blank cell that spans rows takes the other's text."""
    spans = lambda c: c["attrs"].rlike(SPAN)
    short = (F.length(t["content"]) < NAME_CHARS) | (F.length(h["content"]) < NAME_CHARS)
    text = both(t, h, ~((k == NAME_COLUMN) & short) if keyed else None)
    attrs = either(trim_py(t["attrs"]), trim_py(h["attrs"]))
    bare = F.when(text == "", trim_py(F.regexp_replace(attrs, SPAN, ""))).otherwise(attrs)
    tail = cell(t["attrs"], h["content"] if keeps else F.lit(""))
    head = cell(either(h["attrs"], t["attrs"]), t["content"]) if keeps else cell(h["attrs"], F.lit(""))
    return F.when(spans(t) & ~told(t), tail).when(spans(h) & ~told(h), head).otherwise(cell(bare, text))


def rules(key: Column, next_row: Column) -> list[Rule]:
    """In order, over the columns t and h, the cells of the two rows, and p, their pairs where they are as many.

    key: whether the row that a run of rows began with has a key, its first cell; null: as the tail. next_row: whether a
    whole row follows the head.
    """
    n, m = F.size("t"), F.size("h")
    t0, h0 = F.get("t", F.lit(0)), F.get("h", F.lit(0))
    first = lambda a, f: F.array_min(F.filter(F.transform(a, lambda v, k: F.when(f(v), k)), lambda k: k.isNotNull()))
    rest = lambda k: F.transform(F.slice("h", k + 1, F.greatest(m - k, F.lit(0))), kept)
    tails = lambda k: F.transform(F.slice("t", k + 1, F.greatest(n - k, F.lit(0))), kept)
    pairs = lambda f: F.transform("p", lambda q, k: f(q["t"], q["h"], k))
    same_span = lambda q: q["t"]["colspan"] == q["h"]["colspan"]
    equal = lambda q: told(q["t"]) & (q["t"]["content"] == q["h"]["content"])
    attrs = lambda t, h: either(t["attrs"], h["attrs"])

    # rows of as many cells: blank cells of the head up to the first one of another width
    stop = F.coalesce(first("p", lambda q: ~told(q["h"]) & ~same_span(q)), n)
    start = first("p", lambda q: told(q["h"]))
    begun = F.when(start < stop, start)
    blanks = F.filter(F.slice("p", 1, stop), lambda q: ~told(q["h"]))
    again = F.exists(F.slice("p", begun + 1, n), equal)
    until = F.when(F.coalesce(again, F.lit(False)), begun).otherwise(n)
    explicit = lambda q, k: F.when((k < until) & F.get("h", k)["attrs"].rlike(SPAN), F.get("h", k)["rowspan"]).otherwise(0)
    front = F.transform(blanks, lambda q, k: spanning(q["t"], q["h"], explicit(q, k)))
    whole = F.concat(F.transform(blanks, lambda q: spanning(q["t"], q["h"])), F.transform(F.slice("p", F.size(blanks) + 1, n), lambda q: cell(with_span(q["t"]["attrs"], q["t"]["rowspan"] + q["h"]["rowspan"] - 1), both(q["t"], q["h"]))))
    # rows of different numbers of cells: the head's blank cells in front
    ahead = F.coalesce(first(F.arrays_zip(F.slice("t", 1, F.least(n, m)).alias("t"), F.slice("h", 1, F.least(n, m)).alias("h")), lambda q: told(q["h"]) | ~same_span(q)), F.least(n, m))

    some_equal = F.exists("p", equal)
    held = lambda h: h["attrs"].rlike(SPAN) & ~told(h)
    known = F.coalesce(key, told(t0))
    any_head = F.exists("h", told)
    common = F.size(F.filter("p", lambda q: told(q["t"]) & told(q["h"])))
    total = F.size(F.filter("t", told)) + F.size(F.filter("h", told))
    width = F.when(F.lower(t0["attrs"]).contains("colspan"), t0["attrs"]).when(F.lower(h0["attrs"]).contains("colspan"), h0["attrs"]).otherwise("")
    return [
        Rule("no cells", (n == 0) | (m == 0)),
        Rule("single cells", (n == 1) & (m == 1) & told(h0), row_of(F.array(cell(width, both(t0, h0))))),
        Rule("blank cells in front", (n != m) & (n > 1) & (m > 1) & (ahead > 0), row_of(F.concat(F.transform(F.slice("t", 1, ahead), lambda c, k: spanning(c, F.get("h", k))), tails(ahead))), rest(ahead)),
        Rule("other cells", (n != m) | (n == 1)),
        Rule("blank cells, then a value again", (F.size(blanks) > 0) & (until < n), row_of(F.concat(front, tails(until))), rest(until)),
        Rule("blank cells", F.size(blanks) > 0, row_of(whole)),
        Rule("another key", (told(h0) & ~told(t0)) | (told(h0) & told(t0) & (h0["content"] != t0["content"]))),
        Rule(
            "blank spans and a value again", some_equal & F.exists("h", held) & F.coalesce(key, F.lit(False)) & told(t0) & ~told(h0),
            row_of(pairs(lambda t, h, k: F.when(held(h), cell(with_span(h["attrs"], t["rowspan"] + h["rowspan"] - 1), t["content"])).otherwise(cell(attrs(t, h), t["content"])))), F.transform(F.filter("h", lambda h: ~held(h)), kept),
        ),
        Rule("a value again after blank cells", some_equal & (start > 0), row_of(pairs(lambda t, h, k: F.when((k < start) & told(t) & ~told(h), spanning(t, h)).otherwise(cell(attrs(t, h), t["content"])))), rest(start)),
        Rule("a value again", some_equal),
        Rule("a value under a blank cell", F.exists("p", lambda q: told(q["h"]) & ~told(q["t"]))),
        Rule("goes on below its key", known & told(t0) & ~told(h0) & any_head, row_of(pairs(lambda t, h, k: _filled(t, h, k, True, True)))),
        Rule("goes on, then a new row", known & ~told(t0) & ~told(h0) & (next_row | ~any_head)),
        Rule("goes on without a key", known & ~told(t0) & ~told(h0), row_of(pairs(lambda t, h, k: _filled(t, h, k, True, False)))),
        Rule("never a key", ~known & ~told(t0) & ~told(h0)),
        Rule("few columns in common", F.exists("t", told) & any_head & (common < FEW_IN_COMMON * total), row_of(pairs(lambda t, h, k: _filled(t, h, k, False, False)))),
    ]


def merged_rows(pairs: DataFrame) -> DataFrame:
    """+ rule, merged, row, next_row: what becomes of tail and head, the markup of a page's last row and of the next page's
    first one.

    key (boolean): whether the row that the tail goes back to has a key; null: as the tail has. next_row_whole (boolean):
    whether a whole row follows the head; null: no. row is the merged row, or the tail where rows stay apart; next_row is
    what is left of the head of a row merged in part. Null markup has no cells. A row of any other rule stays apart.
    """
    stripped = lambda html: F.transform(cells_of(F.coalesce(html, F.lit(""))), lambda c: c.withField("content", trim_py(c["content"])))
    cells = pairs.withColumn("t", stripped(F.col("tail"))).withColumn("h", stripped(F.col("head")))
    cells = cells.withColumn("p", F.when(F.size("t") == F.size("h"), F.zip_with("t", "h", lambda t, h: F.struct(t.alias("t"), h.alias("h")))).otherwise(F.slice(F.zip_with("t", "h", lambda t, h: F.struct(t.alias("t"), h.alias("h"))), 1, 0)))
    known = rules(F.col("key"), F.coalesce("next_row_whole", F.lit(False)))
    name = F.coalesce(*[F.when(r.holds, r.name) for r in known], F.lit("otherwise"))
    cells = cells.withColumn("rule", name)
    pick = lambda part: F.coalesce(*[F.when(F.col("rule") == r.name, getattr(r, part)) for r in known if getattr(r, part) is not None])
    cells = cells.withColumn("joined", pick("row")).withColumn("left_over", pick("rest"))
    out = cells.withColumn("merged", F.col("joined").isNotNull()).withColumn("row", F.coalesce("joined", "tail"))
    return out.withColumn("next_row", F.when(F.size("left_over") > 0, row_of(F.col("left_over")))).drop("t", "h", "p", "joined", "left_over")


def merged_two_rows(pairs: DataFrame) -> DataFrame:
    """merged_rows of rows that no others belong to: the tail itself tells whether there is a key."""
    return merged_rows(pairs.withColumn("key", has_key(F.col("tail"))).withColumn("next_row_whole", F.lit(False)))
