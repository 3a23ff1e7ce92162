"""Tables found in a page's drawings: boxes of four strokes, grids of all border lines, and lattices of lines that meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]
#: A stroke nearer than this to a straight one is one; lines nearer than this are one border.
STRAIGHT = 2.0


def strokes(drawings: DataFrame) -> DataFrame:
    """Drawings (doc_id, page_no, drawing_no, type, x0, y0, x1, y1) -> (doc_id, page_no, no, flat, at, low, high): the
    boxes of stroked ones (type 's') that are flat or upright, at their upper or left edge."""
    flat = F.abs(F.col("y1") - F.col("y0")) < STRAIGHT
    s = drawings.filter("type = 's'").filter(flat | (F.abs(F.col("x1") - F.col("x0")) < STRAIGHT))
    of = lambda a, b, name: F.when(flat, F.col(a)).otherwise(F.col(b)).alias(name)
    return s.select(*PAGE, F.col("drawing_no").alias("no"), flat.alias("flat"), of("y0", "x0", "at"), of("x0", "y0", "low"), of("x1", "y1", "high"))


def _corners(strokes: DataFrame, near: float) -> DataFrame:
    """(doc_id, page_no, upright, side, upper, flat): an upright's upper or lower end and a flat stroke's end on a side
    that are nearer than `near` in both directions, with the flat stroke. Ends are dealt to squares four times as wide;
    those of uprights to all squares that they may reach into, mostly one."""
    wide = 4 * near
    square = lambda x, y: F.struct(F.floor(x / wide).alias("bx"), F.floor(y / wide).alias("by"))
    reach = lambda c: F.sequence(F.floor((c - near) / wide), F.floor((c + near) / wide))
    squares = lambda x, y: F.flatten(F.transform(reach(x), lambda i: F.transform(reach(y), lambda j: F.struct(i.alias("bx"), j.alias("by")))))
    no, at, low, high = (F.col(c) for c in ("no", "at", "low", "high"))
    none = F.lit(None)
    up = lambda upper, y: F.struct(no.alias("no"), F.lit(upper).alias("first"), at.alias("x"), y.alias("y"), none.cast("double").alias("x0"), none.cast("double").alias("x1"), squares(at, y).alias("squares"))
    side = lambda left, x: F.struct(no.alias("no"), F.lit(left).alias("first"), x.alias("x"), at.alias("y"), low.alias("x0"), high.alias("x1"), F.array(square(x, at)).alias("squares"))
    ends = strokes.dropna(subset=PAGE).select(*PAGE, "flat", F.inline(F.when(F.col("flat"), F.array(side(True, low), side(False, high))).otherwise(F.array(up(True, low), up(False, high)))))
    ends = ends.select(*PAGE, "flat", F.struct("no", "first", "x", "y", "x0", "x1").alias("e"), F.inline("squares"))
    met = ends.groupBy(*PAGE, "bx", "by").agg(F.collect_list(F.when(~F.col("flat"), F.col("e"))).alias("us"), F.collect_list(F.when(F.col("flat"), F.col("e"))).alias("fs"))
    apart = lambda u, f: (F.abs(u["x"] - f["x"]) < near) & (F.abs(u["y"] - f["y"]) < near)
    stroke = lambda f: F.struct(f["no"].alias("no"), f["y"].alias("y"), f["x0"].alias("x0"), f["x1"].alias("x1"))
    corner = lambda u, f: F.struct(u["no"].alias("upright"), F.when(f["first"], "left").otherwise("right").alias("side"), u["first"].alias("upper"), stroke(f).alias("flat"))
    found = F.flatten(F.transform("us", lambda u: F.transform(F.filter("fs", lambda f: apart(u, f)), lambda f: corner(u, f))))
    return met.select(*PAGE, F.inline(found))


def stroke_boxes(drawings: DataFrame, near: float = 5.0, least_width: float = 50.0, least_height: float = 20.0) -> DataFrame:
    """-> (doc_id, page_no, box_no, x0, y0, x1, y1): boxes whose four sides are strokes.

    Two flat strokes with ends at most `near` apart are top and bottom of a box if an upright runs from one to the other
    at their left ends and one at their right ends, each end nearer than `near`. So candidates are pairs of strokes that
    some upright joins, never all pairs of a page. Small boxes go; of boxes with all sides near each other the one whose
    strokes stand first stays: a fold over the boxes of a page, in the order of their strokes.
    """
    along = _corners(strokes(drawings), near).groupBy(*PAGE, "upright", "side").agg(F.collect_set(F.when(F.col("upper"), F.col("flat"))).alias("tops"), F.collect_set(F.when(~F.col("upper"), F.col("flat"))).alias("bottoms"))
    pairs = along.select(*PAGE, "side", F.explode("tops").alias("top"), "bottoms").select(*PAGE, "side", "top", F.explode("bottoms").alias("bottom")).filter("top.no <> bottom.no")
    pairs = pairs.filter((F.abs(F.col("top.x0") - F.col("bottom.x0")) <= near) & (F.abs(F.col("top.x1") - F.col("bottom.x1")) <= near))
    pairs = pairs.filter((F.col("top.x1") - F.col("top.x0") > least_width) & (F.col("bottom.y") - F.col("top.y") > least_height))
    b = pairs.groupBy(*PAGE, "top", "bottom").agg(F.min("side").alias("a"), F.max("side").alias("b")).filter("a <> b")
    box = F.struct(F.least("top.no", "bottom.no").alias("a"), F.greatest("top.no", "bottom.no").alias("b"), F.col("top.x0").alias("x0"), F.col("top.y").alias("y0"), F.col("top.x1").alias("x1"), F.col("bottom.y").alias("y1"))
    kind = "array<struct<a:bigint,b:bigint,x0:double,y0:double,x1:double,y1:double>>"
    same = lambda p, q: (F.abs(p["x0"] - q["x0"]) < near) & (F.abs(p["y0"] - q["y0"]) < near) & (F.abs(p["x1"] - q["x1"]) < near) & (F.abs(p["y1"] - q["y1"]) < near)
    pages = b.groupBy(*PAGE).agg(F.sort_array(F.collect_list(box)).cast(kind).alias("boxes"))
    kept = F.aggregate("boxes", F.array().cast(kind), lambda got, p: F.when(F.exists(got, lambda q: same(p, q)), got).otherwise(F.concat(got, F.array(p))))
    return pages.select(*PAGE, F.posexplode(kept).alias("box_no", "k")).select(*PAGE, "box_no", "k.x0", "k.y0", "k.x1", "k.y1")


def segments(drawings: DataFrame) -> DataFrame:
    """The items (op, x0, y0, x1, y1) of drawings -> (doc_id, page_no, no, flat, at, low, high): straight lines ('l') at
    the mean of their ends, and the four sides of rectangles ('re'); no keeps the order of drawings."""
    e = drawings.select(*PAGE, "drawing_no", F.posexplode("items").alias("item_no", "i")).select(*PAGE, "drawing_no", "item_no", "i.*")
    line = lambda flat, at, low, high: F.struct(F.lit(flat).alias("flat"), at.alias("at"), low.alias("low"), high.alias("high"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    flat, upright = line(True, (y0 + y1) / 2, F.least(x0, x1), F.greatest(x0, x1)), line(False, (x0 + x1) / 2, F.least(y0, y1), F.greatest(y0, y1))
    one = F.when(F.abs(y1 - y0) < STRAIGHT, F.array(flat)).when(F.abs(x1 - x0) < STRAIGHT, F.array(upright))
    four = F.array(line(True, y0, x0, x1), line(True, y1, x0, x1), line(False, x0, y0, y1), line(False, x1, y0, y1))
    e = e.select(*PAGE, "drawing_no", "item_no", F.posexplode(F.when(F.col("op") == "l", one).when(F.col("op") == "re", four)).alias("side", "s"))
    return e.select(*PAGE, F.struct("drawing_no", "item_no", "side").alias("no"), "s.*")


def border_lines(lines: DataFrame) -> DataFrame:
    """Segments -> (doc_id, page_no, flat, line_no, at, low, high): from the first on, a segment nearer than STRAIGHT to a
    border's first one is part of it. The border stays where its first segment is and reaches as far as all of them, so
    this is a fold and no window; equal places go by the order of drawings."""
    own = F.sort_array(F.collect_list(F.struct("at", "no", "low", "high")))
    pages = lines.groupBy(*PAGE, "flat").agg(F.transform(own, lambda s: F.struct(s["at"].alias("at"), s["low"].alias("low"), s["high"].alias("high"))).alias("lines"))
    kind = "array<struct<at:double,low:double,high:double>>"
    last = lambda a: F.try_element_at(a, F.lit(-1))
    wider = lambda a, s: F.struct(last(a)["at"].alias("at"), F.least(last(a)["low"], s["low"]).alias("low"), F.greatest(last(a)["high"], s["high"]).alias("high"))
    part = lambda a, s: F.coalesce(F.abs(s["at"] - last(a)["at"]) < STRAIGHT, F.lit(False))
    merged = F.aggregate(F.col("lines").cast(kind), F.array().cast(kind), lambda a, s: F.when(part(a, s), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(wider(a, s)))).otherwise(F.concat(a, F.array(s))))
    return pages.select(*PAGE, "flat", F.posexplode(merged).alias("line_no", "s")).select(*PAGE, "flat", "line_no", "s.*")


def border_grid(lines: DataFrame) -> DataFrame:
    """Border lines -> (doc_id, page_no, row_index, col_index, x_start, y_start, x_end, y_end): one table a page, with a
    cell between any two neighbouring uprights and any two neighbouring flat lines, wherever they end. Places are
    rounded to a tenth; pages without two of both have no table."""
    at = lines.select(*PAGE, "flat", F.bround("at", 1).alias("at")).distinct()
    by = W.partitionBy(*PAGE, "flat").orderBy("at")
    gaps = at.select(*PAGE, "flat", (F.row_number().over(by) - 1).alias("k"), F.col("at").alias("from"), F.lead("at").over(by).alias("to")).filter(F.col("to").isNotNull())
    rows = gaps.filter("flat").select(*PAGE, F.col("k").alias("row_index"), F.col("from").alias("y_start"), F.col("to").alias("y_end"))
    cols = gaps.filter("not flat").select(*PAGE, F.col("k").alias("col_index"), F.col("from").alias("x_start"), F.col("to").alias("x_end"))
    return rows.join(cols, PAGE).select(*PAGE, "row_index", "col_index", "x_start", "y_start", "x_end", "y_end")


def snapped(lines: DataFrame, snap: float = 5.0, join: float = 5.0, least: float = 3.0) -> DataFrame:
    """Segments -> (doc_id, page_no, flat, line, at, low, high): places at most `snap` from the one before are one place,
    their mean; segments of one place at most `join` apart are one, and those shorter than `least` go."""
    by = W.partitionBy(*PAGE, "flat").orderBy("at")
    s = lines.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(by) > snap, F.lit(True)))
    s = s.withColumn("place", F.sum(F.col("new").cast("int")).over(by)).withColumn("at", F.avg("at").over(W.partitionBy(*PAGE, "flat", "place")))
    along = W.partitionBy(*PAGE, "flat", "place").orderBy("low", "high")
    reach = F.max("high").over(along.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("apart", F.coalesce(F.col("low") - reach > join, F.lit(True)))
    s = s.withColumn("piece", F.sum(F.col("apart").cast("int")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    s = s.groupBy(*PAGE, "flat", "place", "piece").agg(F.first("at").alias("at"), F.min("low").alias("low"), F.max("high").alias("high")).filter(F.col("high") - F.col("low") >= least)
    return s.select(*PAGE, "flat", F.row_number().over(W.partitionBy(*PAGE, "flat").orderBy("at", "low")).alias("line"), "at", "low", "high")


def crossings(lines: DataFrame, near: float = 3.0, band: float = 50.0) -> DataFrame:
    """Snapped lines -> (doc_id, page_no, upright, flat, x, y): where an upright and a flat line meet, or nearly so. They
    are dealt to bands of y, so an upright meets the flat lines along it and not its whole page."""
    at, low, high = (F.col(c) for c in ("at", "low", "high"))
    bands = F.when(F.col("flat"), F.array(F.floor(at / band))).otherwise(F.sequence(F.floor((low - near) / band), F.floor((high + near) / band)))
    own = F.struct("line", "at", "low", "high")
    dealt = lines.dropna(subset=PAGE).select(*PAGE, "flat", own.alias("own"), F.explode(bands).alias("band"))
    both = dealt.groupBy(*PAGE, "band").agg(F.collect_list(F.when(~F.col("flat"), F.col("own"))).alias("us"), F.collect_list(F.when(F.col("flat"), F.col("own"))).alias("fs"))
    meet = lambda u, f: f["at"].between(u["low"] - near, u["high"] + near) & u["at"].between(f["low"] - near, f["high"] + near)
    point = lambda u, f: F.struct(u["line"].alias("upright"), f["line"].alias("flat"), u["at"].alias("x"), f["at"].alias("y"))
    return both.select(*PAGE, F.inline(F.flatten(F.transform("us", lambda u: F.transform(F.filter("fs", lambda f: meet(u, f)), lambda f: point(u, f))))))


def smallest_cells(points: DataFrame) -> DataFrame:
    """Crossings -> (doc_id, page_no, x0, y0, x1, y1, corners): of each crossing the smallest rectangle of lines that it is
    the upper left corner of: the least deep one and of these the narrowest.

    Two flat lines that one upright crosses, and the next upright that crosses both, are a rectangle, so candidates are
    found by ordering the common uprights of two flat lines. corners are numbers of the four crossings in their page.
    """
    points = points.withColumn("corner", F.row_number().over(W.partitionBy(*PAGE).orderBy("y", "x", "flat", "upright")))
    along = points.groupBy(*PAGE, "upright").agg(F.collect_list(F.struct("x", "y", "flat", "corner")).alias("ps"))
    side = lambda p, q: F.struct(p["x"].alias("x"), p["flat"].alias("top"), p["y"].alias("y0"), p["corner"].alias("c0"), q["flat"].alias("bottom"), q["y"].alias("y1"), q["corner"].alias("c1"))
    sides = along.select(*PAGE, "upright", F.inline(F.flatten(F.transform("ps", lambda p: F.transform(F.filter("ps", lambda q: p["y"] < q["y"]), lambda q: side(p, q))))))
    by = W.partitionBy(*PAGE, "top", "bottom").orderBy("x", "upright")
    right = F.lead(F.struct("x", "c0", "c1")).over(by)
    found = sides.withColumn("right", right).filter("right is not null and x < right.x")
    cell = F.min(F.struct("y1", F.col("right.x").alias("x1"), F.col("x").alias("x0"), F.col("y0").alias("y0"), F.array("c0", "c1", "right.c0", "right.c1").alias("corners"))).alias("cell")
    return found.groupBy(*PAGE, "c0").agg(cell).select(*PAGE, "cell.x0", "cell.y0", "cell.x1", "cell.y1", "cell.corners")


def lattice_cells(drawings: DataFrame, least_cells: int = 2, snap: float = 5.0, join: float = 5.0, least: float = 3.0, near: float = 3.0) -> DataFrame:
    """Drawings -> (doc_id, page_no, table_no, x0, y0, x1, y1): the cells of tables drawn with lines.

    Cells that share a corner are of one table, by a fold over a page's cells that unites what a cell touches; tables of
    fewer than least_cells go. Tables are numbered by their first cell, from above, then from the left. A page bounds the
    number of lines and cells, and so every array and group here. Pages without drawings have no rows.
    """
    cells = smallest_cells(crossings(snapped(segments(drawings), snap, join, least), near))
    kind = "array<struct<y0:double,x0:double,x1:double,y1:double,corners:array<int>>>"
    pages = cells.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "y1", "corners"))).cast(kind).alias("cells"))
    none = F.array().cast(f"array<struct<corners:array<int>,cells:{kind}>>")

    def step(tables: Column, c: Column) -> Column:
        touched = F.filter(tables, lambda t: F.arrays_overlap(t["corners"], c["corners"]))
        others = F.filter(tables, lambda t: ~F.arrays_overlap(t["corners"], c["corners"]))
        corners = F.array_union(F.flatten(F.transform(touched, lambda t: t["corners"])), c["corners"])
        return F.concat(others, F.array(F.struct(corners.alias("corners"), F.concat(F.flatten(F.transform(touched, lambda t: t["cells"])), F.array(c)).alias("cells"))))

    tables = F.filter(F.aggregate("cells", none, step), lambda t: F.size(t["cells"]) >= least_cells)
    ordered = F.sort_array(F.transform(tables, lambda t: F.sort_array(t["cells"])))
    e = pages.select(*PAGE, F.posexplode(ordered).alias("table_no", "t")).select(*PAGE, "table_no", F.inline("t"))
    return e.select(*PAGE, (F.col("table_no") + 1).alias("table_no"), "x0", "y0", "x1", "y1")


def lattice_tables(cells: DataFrame) -> DataFrame:
    """Cells of lattices -> (doc_id, page_no, table_no, x0, y0, x1, y1, row_count, col_count, n_cells)."""
    far = lambda f, c: f(c).alias(c)
    kinds = lambda c: F.size(F.collect_set(F.col(c) + 0.0)).cast("long")  # noqa: E731 - a page bounds them, and they take no shuffle of their own
    return cells.groupBy(*PAGE, "table_no").agg(far(F.min, "x0"), far(F.min, "y0"), far(F.max, "x1"), far(F.max, "y1"), kinds("y0").alias("row_count"), kinds("x0").alias("col_count"), F.count(F.lit(1)).alias("n_cells"))
