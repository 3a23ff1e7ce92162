"""Table geometry: matching, chaining over pages, cell grids, votes and markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.geometry import box, overlap_ratio, valid_table
from ..functions.python import ready
from ..functions.text import trim_py
from . import placing

#: What is told of a character.
CHAR = ("doc_id", "char_no", "c", "x0", "y0", "x1", "y1")


def box_antijoin(boxes: DataFrame, tables: DataFrame, most: float = 0.3) -> DataFrame:
    """Boxes that overlap no table of their page by more than `most` of the smaller area."""
    t = tables.select("doc_id", "page_no", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    return boxes.join(t, (boxes["doc_id"] == t["doc_id"]) & (boxes["page_no"] == t["page_no"]) & (overlap_ratio([boxes[c] for c in ("x0", "y0", "x1", "y1")], box("t_")) > most), "left_anti")


def nearest_table(boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """(box_id, table_id, distance): of the page's tables that overlap a box by over 0.3 or whose centre is nearer than
    50, the one with the nearest centre; of equals the first."""
    t = tables.select("doc_id", "page_no", "table_id", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    a, b = box(), box("t_")
    d = F.sqrt(F.pow((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, 2) + F.pow((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2, 2))
    near = boxes.join(t, ["doc_id", "page_no"]).withColumn("distance", d).filter((overlap_ratio(a, b) > 0.3) | (F.col("distance") < 50))
    return near.groupBy("box_id").agg(F.min(F.struct("distance", "table_id")).alias("m")).select("box_id", "m.table_id", F.round("m.distance", 4).alias("distance"))


def valid_tables(tables: DataFrame, strict: bool) -> DataFrame:
    return tables.filter(valid_table(box(), F.col("row_count"), F.col("col_count"), strict))


def follows() -> Column:
    """Whether a table goes on from the one before in its document's list."""
    by = W.partitionBy("doc_id").orderBy("table_id")
    before = lambda c: F.lag(c).over(by)
    w, v = F.col("x1") - F.col("x0"), before("x1") - before("x0")
    return F.coalesce((F.col("page_no") - before("page_no") == 1) & ~before("text_between") & (F.abs(F.col("x0") - before("x0")) <= 20) & (F.least(w, v) / F.greatest(w, v) >= 0.9), F.lit(False))


def chains(tables: DataFrame) -> DataFrame:
    """+ island: the number, in its document, of the run of tables that continue each other over pages."""
    by = W.partitionBy("doc_id").orderBy("table_id")
    return tables.withColumn("go", follows()).withColumn("island", F.sum(F.when(F.col("go"), 0).otherwise(1)).over(by)).drop("go")


def chain_summary(chained: DataFrame) -> DataFrame:
    """One row a run: box, columns and id of its first part, rows summed. Runs of one must be strictly valid, unless
    the document has no other table."""
    first = lambda c: F.min_by(c, "table_id").alias(c)
    runs = chained.groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("page_count"), F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page"), F.sum("row_count").alias("row_count"), *[first(c) for c in ("x0", "y0", "x1", "y1", "col_count")], F.min("table_id").alias("table_id"))
    alone = F.sum("page_count").over(W.partitionBy("doc_id")) == 1
    return runs.withColumn("alone", alone).filter((F.col("page_count") > 1) | F.col("alone") | valid_table(box(), F.col("row_count"), F.col("col_count"), True)).drop("alone")


def covered_pages(summary: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_id): pages that a run covers after its first; of several runs the last in the list."""
    e = summary.filter("start_page < end_page").select("doc_id", "table_id", F.explode(F.sequence(F.col("start_page") + 1, F.col("end_page"))).alias("page_no"))
    return e.groupBy("doc_id", "page_no").agg(F.max("table_id").alias("table_id"))


def column_vote(counts: DataFrame) -> DataFrame:
    """(doc_id, row_no, cols) -> (doc_id, cols): the number of columns that a table is taken to have."""
    k = counts.groupBy("doc_id", "cols").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("f"))
    a = k.groupBy("doc_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kinds"), F.max("cols").alias("most"), F.max_by("cols", F.struct("n", -F.col("f"))).alias("mode"), F.max("n").alias("mode_n"), F.max_by("n", "cols").alias("most_n"))
    pick = F.when(F.col("kinds") == 1, F.col("most")).when(F.col("mode_n") / F.col("rows") > 0.6, F.col("mode")).when(F.col("most_n") / F.col("rows") > 0.3, F.col("most")).when(F.col("most") - F.col("mode") <= 1, F.col("most")).otherwise(F.col("mode"))
    return a.select("doc_id", pick.alias("cols"))


def _beside(chars: DataFrame, cells: DataFrame, most: int = 512) -> DataFrame:
    """(doc_id, chars, cells): characters of a table, in parts of about `most` by their numbers, and its cells, as lists;
    parts of a table stand together. A page bounds a table's cells; characters are shuffled by table only.

    Neither side is sent whole: cells and characters are more than the size of what they are read from tells."""
    sides = ("x_start", "y_start", "x_end", "y_end")
    # structs are made before they are collected, so that they are copied whole and not field by field
    cell = F.struct("row_index", "col_index", *[F.col(c).cast("double").alias(c) for c in sides])
    k = cells.filter(" and ".join(f"{c} is not null" for c in sides)).select("doc_id", cell.alias("cell")).groupBy("doc_id").agg(F.collect_list("cell").alias("cells"))
    parts = chars.select("doc_id", F.floor(F.col("char_no") / most).alias("part"), F.struct(*CHAR[1:]).alias("char")).groupBy("doc_id", "part").agg(F.collect_list("char").alias("chars"))
    return parts.join(k.hint("merge"), "doc_id").select("doc_id", "chars", "cells")


def _kinds(df: DataFrame, *names: str) -> list[StructField]:
    return [StructField(c, df.schema[c].dataType) for c in names]


def char_to_cell(chars: DataFrame, cells: DataFrame, band: float = 50.0) -> DataFrame:
    """(doc_id, char_no, c, x0.., row_index, col_index): each character's first cell, in row order, that its box
    overlaps, or else that holds its centre. A character looks into the bands of y that it reaches, so it meets the cells
    around it and not its whole table. Characters that repeat are placed each."""
    ready(chars.sparkSession)
    kind = StructType([*_kinds(chars, *CHAR), *_kinds(cells, "row_index", "col_index")])
    return _beside(chars, cells).mapInArrow(lambda batches: placing.placed(batches, band), kind)


def _text_kind(chars: DataFrame, cells: DataFrame) -> StructType:
    return StructType([*_kinds(chars, "doc_id"), *_kinds(cells, "row_index", "col_index"), StructField("text", StringType())])


def cell_text(placed: DataFrame, gap: float = 2.0) -> DataFrame:
    """Characters in cells, as char_to_cell gives them -> (doc_id, row_index, col_index, text): a cell's text lines
    joined by <br>, stripped. By y0 and x centre, a character at gap or more from its line's first starts a new line;
    a line's characters stand by x centre."""
    ready(placed.sparkSession)
    by = placed.select(*CHAR, "row_index", "col_index").repartition("doc_id").sortWithinPartitions("doc_id")
    return by.mapInArrow(lambda batches: placing.texts(batches, gap), _text_kind(placed, placed))


def text_in_cells(chars: DataFrame, cells: DataFrame, band: float = 50.0, gap: float = 2.0) -> DataFrame:
    """cell_text of char_to_cell: characters in cells are not shuffled again, as those of a table stand together."""
    ready(chars.sparkSession)
    return _beside(chars, cells).mapInArrow(lambda batches: placing.texts(placing.placed(batches, band), gap), _text_kind(chars, cells))


def spans(cells: DataFrame, xs: Column, ys: Column, tol: float = 2.0) -> DataFrame:
    """+ colspan, rowspan: one more than the lines strictly inside a cell."""
    inside = lambda a, lo, hi: (F.size(F.filter(a, lambda v: (v > F.col(lo) + tol) & (v < F.col(hi) - tol))) + 1)
    return cells.withColumn("colspan", inside(xs, "x_start", "x_end")).withColumn("rowspan", inside(ys, "y_start", "y_end"))


def display_columns(cells: DataFrame) -> DataFrame:
    """(doc_id, row_no, cell_no, colspan, rowspan) -> (doc_id, row_no, cols): the columns that spans from above hold in a
    row and those of its own cells. A fold over a table's rows; its state is how many rows each column is still held."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "colspan", "rowspan"))), lambda c: F.struct(c["colspan"].alias("wide"), c["rowspan"].alias("high")))
    rows = cells.groupBy("doc_id", "row_no").agg(row.alias("cells"))
    ordered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("rows"))
    left = lambda held, c: F.coalesce(F.get(held, c), F.lit(0))
    none = F.array().cast("array<int>")

    def place(s: Column, c: Column) -> Column:
        """A cell goes to the first column from where the last one ended that is not held."""
        at = F.array_min(F.filter(F.sequence(s["at"], F.greatest(s["at"], F.size(s["held"]))), lambda k: left(s["held"], k) == 0))
        end = at + c["wide"]
        held = F.transform(F.sequence(F.lit(0), F.greatest(F.size(s["held"]), end) - 1), lambda k: F.when((k >= at) & (k < end), F.greatest(left(s["held"], k), c["high"])).otherwise(left(s["held"], k)))
        return F.struct(F.when(c["high"] > 1, held).otherwise(s["held"]).alias("held"), end.cast("int").alias("at"))

    def step(s: Column, r: Column) -> Column:
        above = F.size(F.filter(s["held"], lambda n: n > 0))
        own = F.aggregate(r["cells"], F.lit(0), lambda n, c: n + c["wide"])
        held = F.aggregate(r["cells"], F.struct(s["held"].alias("held"), F.lit(0).alias("at")), place)["held"]
        out = F.struct(r["row_no"].cast("int").alias("row_no"), (above + own).cast("int").alias("cols"))
        return F.struct(F.transform(held, lambda n: F.greatest(n - 1, F.lit(0))).alias("held"), F.concat(s["out"], F.array(out)).alias("out"))

    start = F.struct(none.alias("held"), F.array().cast("array<struct<row_no:int,cols:int>>").alias("out"))
    return ordered.select("doc_id", F.inline(F.aggregate("rows", start, step, lambda s: s["out"])))


def columns_shown(counts: DataFrame) -> DataFrame:
    """(doc_id, row_no, cols) -> (doc_id, cols): the widest rows' columns if over 30 % of rows are so wide, else the most
    frequent number, of equals the one met first."""
    k = counts.groupBy("doc_id", "cols").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("f"))
    a = k.groupBy("doc_id").agg(F.sum("n").alias("rows"), F.max("cols").alias("most"), F.max_by("n", "cols").alias("most_n"), F.max_by("cols", F.struct("n", -F.col("f"))).alias("mode"))
    return a.select("doc_id", F.when(F.col("most_n") / F.col("rows") > 0.3, F.col("most")).otherwise(F.col("mode")).alias("cols"))


def expected_columns(counts: DataFrame, tables: DataFrame, first: int = 5) -> DataFrame:
    """(doc_id, row_no, cols) and (doc_id, col_count) -> (doc_id, cols): the widest of the first rows, else what the table
    is said to have, else the widest row; zeros count as unknown."""
    a = counts.groupBy("doc_id").agg(F.max(F.when(F.col("row_no") < first, F.col("cols"))).alias("early"), F.max("cols").alias("most"))
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    return tables.join(a, "doc_id", "left").select("doc_id", F.coalesce(some("early"), some("col_count"), some("most")).alias("cols"))


def effective_columns(row: Column) -> Column:
    """Cells of a row that are not blank, or all if all are."""
    told = F.size(F.filter(row, lambda c: trim_py(F.coalesce(c, F.lit(""))) != ""))
    return F.when(told == 0, F.size(row)).otherwise(told)


def real_tables(tables: DataFrame, drawings: DataFrame, least: int = 3, margin: float = 5.0) -> DataFrame:
    """Tables (doc_id, page_no, table_id, box) with `least` strokes (type 's') or more whose centre is in their box."""
    d = drawings.filter("type = 's'").select("doc_id", "page_no", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    inside = F.col("cx").between(F.col("x0") - margin, F.col("x1") + margin) & F.col("cy").between(F.col("y0") - margin, F.col("y1") + margin)
    n = tables.join(d, ["doc_id", "page_no"]).filter(inside).groupBy("doc_id", "table_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return tables.join(n.select("doc_id", "table_id"), ["doc_id", "table_id"], "left_semi")


def text_follows(tables: DataFrame, lines: DataFrame, height: float = 842.0, margin: float = 80.0, least: float = 10.0) -> DataFrame:
    """+ text_between: whether a text that is not blank reaches into the strip below a table, down to the lower margin, or
    into the one above the next table of the document's list, from the upper margin on; strips of `least` or less count
    as empty. Null pages have no text."""
    by = W.partitionBy("doc_id").orderBy("table_id")
    told = lines.filter(trim_py(F.col("text")) != "").select("doc_id", F.col("page_no").alias("page"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    at = tables.select("doc_id", "table_id", F.array(F.struct(F.col("page_no").alias("page"), F.col("y1").alias("a"), F.lit(height - margin).alias("b")), F.struct(F.lead("page_no").over(by).alias("page"), F.lit(margin).alias("a"), F.lead("y0").over(by).alias("b"))).alias("strips"))
    strips = at.select("doc_id", "table_id", F.inline("strips")).filter(F.col("b") - F.col("a") > least)
    hit = strips.join(told, ["doc_id", "page"]).filter("top < b and bottom > a").select("doc_id", "table_id").distinct().withColumn("hit", F.lit(True))
    return tables.join(hit, ["doc_id", "table_id"], "left").withColumn("text_between", F.coalesce("hit", F.lit(False))).drop("hit")


def cross_page_pairs(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, table_id): tables that go on from the one before in their document's list, with no text between the two
    (see follows, text_follows). Which places can go on is told first, as it takes no text."""
    by = W.partitionBy("doc_id").orderBy("table_id")
    near = tables.withColumn("text_between", F.lit(False)).withColumn("near", follows())
    near = near.withColumn("near", F.col("near") | F.coalesce(F.lead("near").over(by), F.lit(False)))
    told = text_follows(near.filter("near").drop("text_between", "near"), lines).select("doc_id", "table_id", "text_between")
    all_ = tables.join(told, ["doc_id", "table_id"], "left").withColumn("text_between", F.coalesce("text_between", F.lit(True)))
    return all_.withColumn("go", follows()).filter("go").select("doc_id", "table_id")


def chars_in_tables(chars: DataFrame, cells: DataFrame) -> DataFrame:
    """Characters (doc_id, box) that lie whole in the box of their table's cells and a margin around it, a tenth of the
    lowest cell's height but 0.5 at least and 2 at most."""
    t = cells.groupBy("doc_id").agg(F.min("x_start").alias("t_x0"), F.min("y_start").alias("t_y0"), F.max("x_end").alias("t_x1"), F.max("y_end").alias("t_y1"), F.least(F.lit(2.0), F.greatest(F.lit(0.5), 0.1 * F.min(F.col("y_end") - F.col("y_start")))).alias("m"))
    a, m = box(), F.col("m")
    inside = (a[0] >= F.col("t_x0") - m) & (a[1] >= F.col("t_y0") - m) & (a[2] <= F.col("t_x1") + m) & (a[3] <= F.col("t_y1") + m)
    # a row for each table is little to look up, and characters are not sorted for it
    return chars.join(t.hint("shuffle_hash"), "doc_id").filter(inside).select(chars.columns)


def cell_of_lines(lines: DataFrame, gap: float = 2.0) -> DataFrame:
    """(doc_id, box_id, y0, line_no, text) -> (doc_id, box_id, text): the text lines of a box as one cell; <br> before a
    line more than gap below the last, else a space."""
    rows = lines.groupBy("doc_id", "box_id").agg(F.array_sort(F.collect_list(F.struct("y0", "line_no", "text"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda r, k: F.concat(F.when(k == 0, "").when(r["y0"] - F.get("ls", k - 1)["y0"] > gap, "<br>").otherwise(" "), r["text"])), "")
    return rows.select("doc_id", "box_id", text.alias("text"))


def row_groups(cells: DataFrame, near: float = 2.0) -> DataFrame:
    """(doc_id, x0, y0, ...) -> the same with row_index and col_index: rows are the distinct y0, rounded to a tenth; a cell
    is in each row that is nearer than `near`, its columns numbered by x0."""
    by = W.partitionBy("doc_id").orderBy("row_y")
    placed = cells.withColumn("row_y", F.bround("y0", 1)).withColumn("row_no", (F.dense_rank().over(by) - 1).cast("int"))
    # rows of a cell are those around its own; rounding moves both places by half a tenth at most
    wide = near + 0.2
    placed = placed.withColumn("around", F.expr(f"collect_set(struct(row_y, row_no)) over (partition by doc_id order by row_y range between {wide}D preceding and {wide}D following)"))
    own = F.filter("around", lambda r: F.abs(F.col("y0") - r["row_y"]) < near)
    placed = placed.select(*cells.columns, F.explode(F.transform(own, lambda r: r["row_no"])).alias("row_index"))
    return placed.withColumn("col_index", (F.row_number().over(W.partitionBy("doc_id", "row_index").orderBy("x0", "y0")) - 1).cast("int"))
