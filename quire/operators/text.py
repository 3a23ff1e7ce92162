"""Header, footer and page-number operators over layout lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import BOX, box, contains
from ..functions.text import is_page_number, trim_py
from .merge import in_order, with_page_info

PAGE_HEIGHT = 842.0
MARGIN = 0.15


def line_regions(lines: DataFrame, height: float = PAGE_HEIGHT, margin: float = MARGIN) -> DataFrame:
    """+ region: header above the upper margin, else footer below the lower, else null."""
    return lines.withColumn("region", F.when(F.col("y0") < height * margin, "header").when(F.col("y1") > height * (1 - margin), "footer"))


def common_texts(lines: DataFrame, least_pages: int = 2) -> DataFrame:
    """(doc_id, region, text, pages): texts of a region that stand on least_pages different pages or more."""
    tagged = line_regions(lines).filter("region is not null")
    return tagged.groupBy("doc_id", "region", "text").agg(F.countDistinct("page_no").alias("pages")).filter(F.col("pages") >= least_pages)


def clean_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): a page's lines without repeated headers and footers and without page numbers there."""
    tagged = line_regions(lines)
    kept = tagged.join(common_texts(lines).select("doc_id", "region", "text"), ["doc_id", "region", "text"], "left_anti").filter(~(F.col("region").isNotNull() & is_page_number(F.col("text"))))
    return kept.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n").alias("text"))


def joined_lines(when: Column) -> Column:
    """Aggregate of lines (y0, line_no, text): those for which `when` holds, by y0, joined by line ends and stripped."""
    return trim_py(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("y0", "line_no", "text")))), lambda r: r["text"]), "\n"))


def outside_tables(lines: DataFrame, tables: DataFrame, margin: float = 5.0) -> DataFrame:
    """Lines (doc_id, page_no, x0, y0, x1, y1) that lie in no table of their page, give or take a margin."""
    t = tables.select(F.col("doc_id").alias("t_doc"), F.col("page_no").alias("t_page"), *[F.col(c).alias(f"t_{c}") for c in BOX])
    return lines.join(t, (F.col("doc_id") == F.col("t_doc")) & (F.col("page_no") == F.col("t_page")) & contains(box("t_"), box(), margin), "left_anti")


def text_excluding_tables(lines: DataFrame, tables: DataFrame, margin: float = 5.0) -> DataFrame:
    """(doc_id, page_no, before, after): a page's text outside its tables, above the topmost table and the rest; all of
    it is before on a page without tables. Pages of which all text is in tables have two empty texts."""
    top = tables.groupBy("doc_id", "page_no").agg(F.min("y0").alias("top"))
    pages = lines.select("doc_id", "page_no").distinct().join(top, ["doc_id", "page_no"], "left")
    told = outside_tables(lines, tables, margin).join(top, ["doc_id", "page_no"], "left")
    above = F.col("top").isNull() | (F.col("y0") < F.col("top"))
    told = told.groupBy("doc_id", "page_no").agg(joined_lines(above).alias("before"), joined_lines(~above).alias("after"))
    return pages.select("doc_id", "page_no").join(told, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


def text_between_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_id, text): the lines outside tables that start between the end of the table before, by y0
    on its page, and the start of a table; the first table of a page has none."""
    by = W.partitionBy("doc_id", "page_no").orderBy("y0", "table_id")
    gaps = tables.select("doc_id", "page_no", "table_id", F.lag("y1").over(by).alias("gap0"), F.col("y0").alias("gap1")).filter("gap0 < gap1")
    told = outside_tables(lines, tables).join(gaps, ["doc_id", "page_no"]).filter("gap0 < y0 and y0 < gap1")
    return told.groupBy("doc_id", "page_no", "table_id").agg(joined_lines(F.lit(True)).alias("text"))


def blocks_of_body(blocks: DataFrame, height: float = PAGE_HEIGHT, tolerance: float = 5.0) -> DataFrame:
    """(doc_id, page_no, text): a page's blocks (block_no, text, y0, y1) that stand between the margins and are not blank."""
    body = blocks.filter((F.col("y0") >= height * MARGIN - tolerance) & (F.col("y1") <= height * (1 - MARGIN) + tolerance) & (trim_py(F.col("text")) != ""))
    rows = F.array_sort(F.collect_list(F.struct("y0", "block_no", "text")))
    return body.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page_no, block_no, line_no, span_no, text, x0, y0, x1, y1) -> lines with the text of their spans,
    stripped, and the box of the first; blank lines go."""
    by = ["doc_id", "page_no", "block_no", "line_no"]
    first = F.min_by(F.struct(*BOX), "span_no").alias("b")
    text = trim_py(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]), ""))
    return spans.groupBy(*by).agg(text.alias("text"), first).filter("text <> ''").select(*by, "text", "b.*")


def text_blocks(spans: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_no, text, y0, y1): blocks of spans, joined without line ends; blank ones go, and those
    equal to a repeated header or footer (doc_id, text)."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "span_no", "text")))
    blocks = spans.groupBy("doc_id", "page_no", "block_no").agg(F.array_join(F.transform(rows, lambda s: s["text"]), "").alias("text"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return blocks.filter(trim_py(F.col("text")) != "").withColumn("stripped", trim_py(F.col("text"))).join(repeated.select("doc_id", F.col("text").alias("stripped")).distinct(), ["doc_id", "stripped"], "left_anti").drop("stripped")


def page_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): a document's pages (page_no, text) under their marks; blank pages go, and so do blank documents."""
    told = pages.withColumn("text", trim_py(F.coalesce("text", F.lit("")))).filter("text <> ''")
    return in_order(told.select("doc_id", "page_no", with_page_info(F.col("page_no"), F.col("text")).alias("text")), "page_no")


def page_details(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, has_text)."""
    return pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"), (trim_py(F.coalesce("text", F.lit(""))) != "").alias("has_text"))
