"""Cell grids written as table markup, by expressions over a table's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import merge_coords
from ..functions.text import escape_html

GAP = 2.0
#: Fixed value: a place that no cell covers.
EMPTY = "    <td></td>"


def grid_lines(values: Column, gap: float = GAP) -> Column:
    """Lines of coordinates rounded to a tenth; near ones are one line (see merge_coords)."""
    return merge_coords(F.transform(values, lambda v: F.bround(v, 1)), gap)


def line_at(lines: Column, value: Column, gap: float = GAP) -> Column:
    """Number of the nearest line, if nearer than gap, else null; of two as near the first."""
    near = F.transform(F.filter(lines, lambda v: F.abs(v - value) < gap), lambda v: F.struct(F.abs(v - value).alias("far"), v.alias("line")))
    return (F.array_position(lines, F.array_min(near)["line"]) - 1).cast("int")


def lines_inside(lines: Column, low: Column, high: Column, gap: float = GAP) -> Column:
    return F.size(F.filter(lines, lambda v: (v > low + gap) & (v < high - gap)))


def _at_lines(c: Column) -> Column:
    """A cell with the lines that it starts and ends at."""
    return F.struct(c.alias("c"), line_at(F.col("xs"), c["x_start"]).alias("left"), line_at(F.col("xs"), c["x_end"]).alias("right"))


def _spanning(p: Column) -> Column:
    """A cell with the column after it and its spans, which only cells between two lines have."""
    c, spans = p["c"], F.coalesce(p["right"] > p["left"], F.lit(False))
    wide = F.when(spans, 1 + lines_inside(F.col("xs"), c["x_start"], c["x_end"])).otherwise(1)
    high = F.when(spans, 1 + lines_inside(F.col("ys"), c["y_start"], c["y_end"])).otherwise(1)
    return F.struct(p["left"].alias("left"), F.when(spans, p["right"]).otherwise(p["left"] + 1).alias("after"), wide.alias("wide"), high.alias("high"), c["text"].alias("text"))


def _written(c: Column) -> Column:
    span = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
    return F.concat(F.lit("    <td"), span("colspan", c["wide"]), span("rowspan", c["high"]), F.lit(">"), escape_html(c["text"]), F.lit("</td>"))


def _sequence(low: Column, upto: Column) -> Column:
    """low, low + 1, ... below upto."""
    return F.when(low < upto, F.sequence(low, upto - 1)).otherwise(F.array().cast("array<int>"))


def html_tables(cells: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(doc_id, row_index, col_index, x_start, y_start, x_end, y_end, text) -> (doc_id, html), a row a table of one page.

    Grid lines are the cells' own edges, or shared (doc_id, xs), those of the run of tables that a table belongs to, if
    there are no fewer. A cell spans one column more than there are vertical lines inside it, and rows likewise. Cells
    that start at no line are left out; a place that neither a cell nor a span from above covers is an empty cell. Null
    text is empty. A page bounds the lines of a table, and so all arrays here. Cells that are dealt by doc_id are not
    shuffled again; others are by rows, then by tables.
    """
    names = ["row_index", "col_index", "x_start", "y_start", "x_end", "y_end", "text"]
    rows = cells.select("doc_id", *names).groupBy("doc_id", "row_index").agg(F.sort_array(F.collect_list(F.struct("x_start", "col_index", "y_start", "x_end", "y_end", "text"))).alias("cells"))
    t = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row_index", "cells"))).alias("rows"))
    edges = lambda *ends: F.flatten(F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: F.array(*[c[e] for e in ends])))))
    t = t.withColumn("xs", grid_lines(edges("x_start", "x_end"))).withColumn("ys", grid_lines(edges("y_start", "y_end")))
    if shared is not None:
        own = shared.select("doc_id", F.col("xs").alias("run_xs"))
        t = t.join(own, "doc_id", "left").withColumn("xs", F.when(F.size("run_xs") >= F.greatest(F.size("xs"), F.lit(1)), F.col("run_xs")).otherwise(F.col("xs")))
    placed = F.transform("rows", lambda r: F.transform(F.filter(F.transform(r["cells"], _at_lines), lambda p: p["left"].isNotNull()), _spanning))
    t = t.select("doc_id", (F.size("xs") - 1).alias("width"), placed.alias("rows"))
    # places that spans hold in later rows, as row * (width + 1) + column
    below = lambda c, r: F.flatten(F.transform(_sequence(r + 1, r + c["high"]), lambda k: F.transform(_sequence(c["left"], c["left"] + c["wide"]), lambda j: k * (F.col("width") + 1) + j)))
    taken = F.flatten(F.transform("rows", lambda row, r: F.flatten(F.transform(F.filter(row, lambda c: c["high"] > 1), lambda c: below(c, r)))))
    t = t.withColumn("taken", F.array_distinct(taken))
    gaps = lambda r, low, upto: F.transform(F.filter(_sequence(low, upto), lambda k: ~F.array_contains("taken", r * (F.col("width") + 1) + k)), lambda k: F.lit(EMPTY))
    ends = lambda row, k: F.coalesce(F.get(row, k)["after"], F.lit(0))

    def written(row: Column, r: Column) -> Column:
        told = F.flatten(F.transform(row, lambda c, k: F.concat(gaps(r, ends(row, k - 1), c["left"]), F.array(_written(c)))))
        return F.array_join(F.concat(F.array(F.lit("  <tr>")), told, gaps(r, ends(row, F.size(row) - 1), F.col("width")), F.array(F.lit("  </tr>"))), "\n")

    lines = F.concat(F.array(F.lit("<table>")), F.transform("rows", written), F.array(F.lit("</table>")))
    return t.select("doc_id", F.array_join(lines, "\n").alias("html"))
