"""Joining page text with OCR text, document types and the mode to parse in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_py

# Marks and banners of the merged text.
BANNER, INSTEAD, REPORT = "[图片OCR结果]", "[使用图片OCR结果]", "图片OCR识别结果"
METADATA, FILE = "文件元数据", "文件: "
#: Characters under which a page's text gives way to OCR text.
SCANT = 50


def page_mark(page_no: Column) -> Column:
    return F.concat(F.lit("==第"), page_no.cast("string"), F.lit("页=="))


def image_mark(name: Column) -> Column:
    return F.concat(F.lit("[图片: "), name, F.lit("]"))


def joined(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) and (doc_id, page_no, img_no, y0, name, text) -> pages with `images`, the names and OCR
    texts of their images in image order (y0, img_no), null where a page has none. An image without OCR text has ''."""
    item = F.struct(F.col("y0").cast("double").alias("y0"), F.col("img_no").cast("long").alias("img_no"), F.col("name"), F.coalesce("text", F.lit("")).alias("text"))
    told = ocr.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(item)).alias("images"))
    return pages.join(told, ["doc_id", "page_no"], "left")


def ocr_text(images: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(images, lambda i: i["text"]), "\n"), F.lit(""))


def merged(strategy: str) -> Column:
    """A page (text, images) as a block: its mark, text and OCR texts, and an empty line. replace: OCR text instead of a
    scant text; interleave: no banner; any other name: append."""
    text = F.coalesce("text", F.lit(""))
    has = F.col("images").isNotNull()
    own = F.when(trim_py(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    items = F.flatten(F.transform(F.coalesce("images", F.array()), lambda i: F.array(F.concat(F.lit("\n"), image_mark(i["name"])), i["text"])))
    banner = lambda b: F.when(has, F.array(F.lit(b))).otherwise(F.array().cast("array<string>"))
    if strategy == "replace":
        scant = has & (F.length(trim_py(text)) < SCANT)
        body = F.when(scant, F.concat(F.array(F.lit(INSTEAD)), items)).otherwise(F.concat(F.array(text), banner(f"\n{BANNER}"), items))
    elif strategy == "interleave":
        body = F.concat(own, items)
    else:
        body = F.concat(own, banner(f"\n{BANNER}"), items)
    return F.array_join(F.concat(F.array(page_mark(F.col("page_no"))), body, F.array(F.lit(""))), "\n")


def in_order(blocks: DataFrame, *order: str) -> DataFrame:
    """(doc_id, order..., text) -> (doc_id, text): a document's blocks joined by line ends."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def merged_documents(pages: DataFrame, ocr: DataFrame, strategy: str = "append") -> DataFrame:
    return in_order(joined(pages, ocr).select("doc_id", "page_no", merged(strategy).alias("text")), "page_no")


def simply_merged(documents: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, text) with all OCR texts (doc_id, page_no, img_no, y0, name, text) after it, under one banner."""
    item = F.struct("page_no", F.col("y0").cast("double").alias("y0"), F.col("img_no").cast("long").alias("img_no"), "name", F.coalesce("text", F.lit("")).alias("text"))
    told = ocr.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("images"))
    own = F.when(F.coalesce("text", F.lit("")) != "", F.array(F.col("text"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    rule = F.lit("=" * 50)
    items = F.flatten(F.transform("images", lambda i: F.array(image_mark(i["name"]), i["text"], F.lit(""))))
    report = F.when(F.col("images").isNotNull(), F.concat(F.array(rule, F.lit(REPORT), rule, F.lit("")), items)).otherwise(F.array().cast("array<string>"))
    return documents.join(told, "doc_id", "left").select("doc_id", F.array_join(F.concat(own, report), "\n").alias("text"))


def section(title: Column, text: Column, width: int = 50) -> Column:
    """A titled block of a report of sections (or, with a width of 60 and FILE before its name, of files)."""
    rule = F.lit("=" * width)
    return F.concat_ws("\n", rule, title, rule, F.lit(""), F.coalesce(text, F.lit("")), F.lit(""))


def with_metadata(metadata: Column, text: Column) -> Column:
    """A text under its metadata, an array of (key, value) in order."""
    rule = F.lit("=" * 60)
    told = F.array_join(F.transform(metadata, lambda m: F.concat(m["key"], F.lit(": "), F.coalesce(m["value"], F.lit("")))), "\n")
    return F.concat_ws("\n", rule, F.lit(METADATA), rule, F.nullif(told, F.lit("")), rule, F.lit(""), F.coalesce(text, F.lit("")))


def with_page_info(page_no: Column, text: Column, numbers: bool = True) -> Column:
    """A page's block of a document that is joined by pages."""
    return F.concat_ws("\n", *([page_mark(page_no)] if numbers else []), F.coalesce(text, F.lit("")), F.lit(""))


def document_type(pages: DataFrame, first: int = 3, least: int = 100) -> DataFrame:
    """(doc_id, page_no, text, has_image) -> (doc_id, type): text, scanned or mixed, by the first pages."""
    p = pages.filter(F.col("page_no") <= first).withColumn("is_text", F.length(trim_py(F.coalesce("text", F.lit("")))) > least)
    a = p.groupBy("doc_id").agg(F.count_if("is_text").alias("texts"), F.count_if(~F.col("is_text") & F.col("has_image")).alias("scans"))
    return a.select("doc_id", F.when(F.col("texts") > F.col("scans"), "text").when(F.col("scans") > F.col("texts"), "scanned").otherwise("mixed").alias("type"))


def structure(pages: DataFrame) -> DataFrame:
    """A document's pages, characters, pages with images, and blank pages in order."""
    blank = trim_py(F.coalesce("text", F.lit(""))) == ""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.bool_or("has_image").alias("has_images"), F.count_if("has_image").alias("image_pages"), F.count_if(blank).alias("blank_pages"))


def page_structure(pages: DataFrame, tables: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """(doc_id, page_no, text, has_image) and tables (doc_id, page_no) -> + has_table, density (characters for each
    square point, rounded to 6 places) and the page's kind."""
    t = tables.select("doc_id", "page_no").distinct().withColumn("t", F.lit(True))
    chars = F.length(F.coalesce("text", F.lit("")))
    kind = F.when(F.col("t") & F.col("has_image"), "mixed").when(F.col("t"), "table").when(F.col("has_image"), "image").otherwise("text")
    return pages.join(t, ["doc_id", "page_no"], "left").select("doc_id", "page_no", "has_image", F.coalesce("t", F.lit(False)).alias("has_table"), F.round(chars / F.lit(width * height), 6).alias("density"), kind.alias("kind"))


def page_lists(structured: DataFrame) -> DataFrame:
    """page_structure -> (doc_id, has_tables, has_images, table_pages, image_pages): the pages in order."""
    pages = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("page_no"))))
    return structured.groupBy("doc_id").agg(F.bool_or("has_table").alias("has_tables"), F.bool_or("has_image").alias("has_images"), pages("has_table").alias("table_pages"), pages("has_image").alias("image_pages"))


def recommended(types: DataFrame, structures: DataFrame) -> DataFrame:
    """The mode to parse in and why; a document of which neither is known is parsed in full."""
    t, has = F.col("type"), F.col("has_images")
    plain = F.coalesce((t == "text") & ~has, F.lit(False))
    return types.join(structures, "doc_id", "full").select("doc_id", "type", F.when(plain, "coarse").otherwise("complete").alias("mode"), F.when(t.isNull() | has.isNull(), "unknown").when(plain, "text only").when(t == "scanned", "scanned").otherwise("images").alias("reason"))
