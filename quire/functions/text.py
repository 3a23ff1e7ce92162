"""Text rules of page content as column expressions, with the whitespace and line-end rules of Python's str."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a page-number line, and the marker between pages.
PAGE_NUMBER = r"(?U)^\s*(?:第\s*\d+\s*页|\d+)\s*\z"
PAGE_MARK = r"==第(\d+)页=="
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def trim_py(x: Column) -> Column:
    """str.strip(): all Unicode white space goes from both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def splitlines_py(x: Column) -> Column:
    """str.splitlines(): all line ends, no empty piece after the last."""
    parts = F.split(x, LINE_ENDS)
    return F.when(x == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def strip_edge_page_numbers(x: Column) -> Column:
    """Page-number lines at the start and end go, as far as they are contiguous."""
    lines = splitlines_py(x)
    keep = F.filter(F.transform(lines, lambda v, k: F.when(~is_page_number(v), k)), lambda k: k.isNotNull())
    return F.when(F.size(keep) == 0, F.lit("")).otherwise(F.array_join(F.slice(lines, keep[0] + 1, F.element_at(keep, -1) - keep[0] + 1), "\n"))


def clean_text(x: Column, repeated: Column | None = None) -> Column:
    """Page-number lines, at the edges and inside, and lines equal to a repeated header or footer go; stripped."""
    keep = lambda v: ~is_page_number(v) if repeated is None else ~is_page_number(v) & ~F.array_contains(repeated, v)
    return trim_py(F.array_join(F.filter(F.split(x, LINE_ENDS), keep), "\n"))


def remove_simple(x: Column, header_lines: int = 2, longest_number: int = 4) -> Column:
    """Without statistics: the first lines go, then a short number, and blank lines at the end; up to 3 lines stay."""
    lines = F.split(x, "\n")
    body = F.slice(lines, header_lines + 1, F.size(lines))
    first = F.coalesce(F.get(body, F.lit(0)), F.lit(""))
    number = trim_py(first).rlike(r"(?U)^\d+\z") & (F.length(trim_py(first)) <= longest_number)
    body = F.when(number, F.slice(body, 2, F.size(body))).otherwise(body)
    return F.when(F.size(lines) <= header_lines + 1, x).otherwise(trim_py(F.array_join(body, "\n")))


def collapse_blank_lines(x: Column) -> Column:
    """Of a run of blank lines only the first stays."""
    lines = F.split(x, "\n")
    blank = lambda v: trim_py(v) == ""
    return F.array_join(F.filter(lines, lambda v, k: ~blank(v) | (k == 0) | ~F.coalesce(blank(F.get(lines, k - 1)), F.lit(False))), "\n")


def split_pages(x: Column) -> Column:
    """array<struct<page_no, text>> of a text with page markers; what stands before the first goes, of equal pages the
    last stays (in map order of first appearance)."""
    texts = F.split(x, r"==第\d+页==")
    numbers = F.regexp_extract_all(x, F.lit(PAGE_MARK), F.lit(1))
    pairs = F.transform(numbers, lambda n, k: F.struct(n.cast("int").alias("page_no"), trim_py(F.get(texts, k + 1)).alias("text")))
    return F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["page_no"] == p["page_no"]))


# What is escaped, in this order, and what is not.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
BREAK = "<br>"


def escape_html(x: Column) -> Column:
    """& < > and double quotes are escaped between the line breaks <br>; null is empty."""
    out, mark = F.coalesce(x, F.lit("")), BREAK
    for raw, safe in ESCAPES:
        out, mark = F.replace(out, F.lit(raw), F.lit(safe)), mark.replace(raw, safe)
    # only a break reads as an escaped one here: an & of the text is escaped itself
    return F.replace(out, F.lit(mark), F.lit(BREAK))


def cells_of(row_html: Column) -> Column:
    """array<struct<attrs, content, colspan, rowspan>> of the cells of a row's markup."""
    cell = F.lit(r"(?is)<td([^>]*)>(.*?)</td>")
    attrs, content = F.regexp_extract_all(row_html, cell, F.lit(1)), F.regexp_extract_all(row_html, cell, F.lit(2))
    span = lambda a, name: F.coalesce(F.nullif(F.regexp_extract(a, rf'(?i){name}\s*=\s*["\']?(\d+)', 1), F.lit("")).cast("int"), F.lit(1))
    return F.zip_with(attrs, content, lambda a, c: F.struct(a.alias("attrs"), c.alias("content"), span(a, "colspan").alias("colspan"), span(a, "rowspan").alias("rowspan")))


def first_page(label: Column) -> Column:
    """The page on which '13' or '13-26' starts; null where no whole number stands there."""
    return trim_py(F.split(label, "-", 2)[0]).try_cast("int")


def has_key_cell(row_html: Column) -> Column:
    """Whether the first cell of a row in markup holds more than white space; false where there is none, and for null."""
    return F.coalesce(trim_py(F.regexp_extract(row_html, r"(?is)<td[^>]*>(.*?)</td>", 1)) != "", F.lit(False))
