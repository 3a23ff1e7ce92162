"""A document put together, page by page, from its text, tables and image texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX, contains
from ..functions.text import clean_text, strip_edge_page_numbers, trim_py
from .merge import in_order

# Page headings, table headings, and what stands for a table that could not be read.
PAGE, TABLE, TABLE_TO, UNREAD = ("第 ", " 页"), ("表格（第", "页）"), "-", "(未能识别)"


def page_heading(page_no: Column) -> Column:
    return F.concat(F.lit(PAGE[0]), page_no.cast("string"), F.lit(PAGE[1]))


def table_text(start: Column, end: Column, html: Column) -> Column:
    """A table under its heading."""
    pages = F.concat(start.cast("string"), F.when(end > start, F.concat(F.lit(TABLE_TO), end.cast("string"))).otherwise(""))
    told = F.coalesce(F.nullif(strip_edge_page_numbers(html), F.lit("")), F.lit(UNREAD))
    return F.concat(F.lit(TABLE[0]), pages, F.lit(f"{TABLE[1]}\n\n"), told)


def tables_by_page(tables: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_ids): tables by the page that they start on, by y0; an unknown y0 is 0."""
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("y0", F.lit(0.0)).alias("y0"), "table_id")))
    return tables.groupBy("doc_id", F.col("start_page").alias("page_no")).agg(F.transform(rows, lambda t: t["table_id"]).alias("table_ids"))


def images_by_page(images: DataFrame) -> DataFrame:
    """(doc_id, page_no, img_no, y0, text) with OCR text only, an unknown y0 as 0."""
    return images.filter(F.coalesce("text", F.lit("")) != "").select("doc_id", "page_no", "img_no", F.coalesce("y0", F.lit(0.0)).alias("y0"), "text")


def assembled(pages: DataFrame, blocks: DataFrame, tables: DataFrame, parts: DataFrame, images: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """-> (doc_id, text): pages in order, each under its heading with its text, tables and image texts.

    pages (doc_id, page_no, text); blocks (doc_id, page_no, line_no, text, x0, y0, x1, y1) of text; tables (doc_id,
    table_id, start_page, end_page, x0, y0, x1, y1, html), with the box on their first page; parts (doc_id, table_id,
    page_no, x0, y0, x1, y1), their boxes on later pages; images (doc_id, page_no, img_no, y0, text); repeated (doc_id,
    text), headers and footers, which go from every text, as page numbers do.

    A page with boxes of tables has the text outside them: what starts above the topmost one, then the tables by y0 and
    what is left; if there are two boxes or more, the text between two, by where it starts, stands between them, and
    what starts beside one is left out. A page without tables has its text, or, if it has images and blocks, these in
    one order by y0. Image texts stand last else. Text of one place is cleaned as a whole and is one element; each
    element is followed by an empty line, and so is each page. A page that a table covers from an earlier one is left
    out, with tables of its own too, if nothing of its text is outside tables and it has no image; of several such
    tables the last in order counts. Nothing is said twice. Null texts are empty; an unknown box takes no text away.

    All that a page holds comes together in one shuffle; a page bounds the arrays, a document the row that it becomes.
    """
    by, kinds = ["doc_id", "page_no"], {}
    box = F.struct(F.coalesce("y0", F.lit(0.0)).cast("double").alias("y0"), F.lit(False).alias("part"), F.col("table_id").cast("long").alias("id"), F.col("y1").cast("double").alias("y1"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"))
    kinds["page"] = pages.select(*by, F.coalesce("text", F.lit("")).alias("v"))
    kinds["block"] = blocks.filter(trim_py(F.col("text")) != "").select(*by, F.struct(F.col("y0").cast("double").alias("y0"), F.col("line_no").cast("long").alias("no"), F.col("text"), *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y1")]).alias("v"))
    own = tables.select("doc_id", F.col("start_page").alias("page_no"), box.withField("text", table_text(F.col("start_page"), F.col("end_page"), F.col("html"))).alias("v"))
    kinds["table"] = own
    kinds["part"] = parts.select(*by, box.withField("part", F.lit(True)).withField("text", F.lit("")).alias("v"))
    kinds["cover"] = tables.filter("start_page < end_page").select("doc_id", F.explode(F.sequence(F.col("start_page") + 1, F.col("end_page"))).alias("page_no"), F.col("table_id").cast("long").alias("v"))
    kinds["picture"] = images_by_page(images).select(*by, F.struct(F.col("y0").cast("double").alias("y0"), F.col("img_no").cast("long").alias("no"), "text").alias("v"))
    rows = None
    for name, df in kinds.items():
        df = df.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col("v").alias(name))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    p = rows.groupBy(*by).agg(F.max("page").alias("page"), F.max("cover").alias("cover"), *[F.sort_array(F.collect_list(c)).alias(f"{c}s") for c in ("block", "table", "part", "picture")])
    p = p.filter(F.col("page").isNotNull() | (F.size("tables") > 0) | (F.size("pictures") > 0))
    known = None
    if repeated is not None:
        p = p.join(repeated.groupBy("doc_id").agg(F.collect_set("text").alias("known")), "doc_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
        known = F.col("known")
    clean = lambda x: clean_text(x, known)

    p = p.withColumn("slots", F.sort_array(F.concat("tables", F.slice(F.filter("parts", lambda q: q["id"] == F.col("cover")), 1, 1))))
    p = p.withColumn("outside", F.filter("blocks", lambda b: ~F.exists("slots", lambda s: F.coalesce(contains([s[c] for c in BOX], [b[c] for c in BOX]), F.lit(False)))))
    p = p.withColumn("top", F.array_min(F.transform(F.filter("slots", lambda s: s["y1"].isNotNull()), lambda s: s["y0"])))
    told = lambda when: clean(F.array_join(F.transform(F.filter("outside", when), lambda b: b["text"]), "\n"))
    covered, boxed, tabled = F.col("cover").isNotNull(), F.col("top").isNotNull(), F.size("tables") > 0
    text = clean(F.coalesce("page", F.lit("")))
    p = p.withColumn("before", F.when(boxed, told(lambda b: b["y0"] < F.col("top"))).when(covered, "").otherwise(text))
    p = p.withColumn("after", F.when(boxed, told(lambda b: b["y0"] >= F.col("top"))).when(covered, text).otherwise(""))
    p = p.filter(~covered | (F.col("before") != "") | (F.col("after") != "") | (F.size("pictures") > 0))
    mixed = (F.size("pictures") > 0) & (F.size("outside") > 0) & ~tabled
    until = lambda k: F.coalesce(F.get("slots", k - 1)["y1"], F.lit(0.0))
    gap = lambda s, k: F.when((k > 0) & s["y1"].isNotNull(), told(lambda b: (b["y0"] > until(k)) & (b["y0"] < s["y0"]))).otherwise("")
    between = F.flatten(F.transform("slots", lambda s, k: F.array(gap(s, k), s["text"])))
    rest = F.when(F.element_at("slots", -1)["y1"].isNotNull(), told(lambda b: b["y0"] > F.element_at("slots", -1)["y1"])).otherwise("")
    listed = F.when((F.size("outside") > 0) & (F.size("slots") > 1), F.concat(between, F.array(rest))).otherwise(F.concat(F.transform("tables", lambda s: s["text"]), F.array("after")))
    seen = lambda a, kind: F.transform(a, lambda v: F.struct(v["y0"].alias("y0"), F.lit(kind).alias("kind"), v["no"].alias("no"), v["text"].alias("text")))
    one_order = F.transform(F.sort_array(F.concat(seen("outside", 0), seen("pictures", 1))), lambda v: clean(v["text"]))
    body = F.when(tabled, F.concat(F.array("before"), listed)).when(mixed, one_order).otherwise(F.array("before", "after"))
    pictured = F.when(mixed, F.array().cast("array<string>")).otherwise(F.transform("pictures", lambda v: clean(v["text"])))
    elements = F.filter(F.concat(F.array(page_heading(F.col("page_no"))), body, pictured), lambda e: e != "")
    return in_order(p.select(*by, F.array_join(F.transform(elements, lambda e: F.concat(e, F.lit("\n\n"))), "").alias("text")), "page_no")
