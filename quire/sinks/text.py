"""Results as text files: names, contents, and a writer that puts each text under its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_py
from ..sources import xlsx
from .files import MARK

#: What result files are called and what stands at their top.
FINAL_NAME = "%s_完整解析含表格_%s.txt"
RULE = "=" * 80 + "\n\n"


def final_name(base: Column, stamp: Column) -> Column:
    return F.format_string(FINAL_NAME, base, stamp)


def stem(name: Column) -> Column:
    """A file's name without its extension; dots at the front are no extension's."""
    return F.regexp_replace(name, r"(?s)^((?:.*/)?\.*[^./][^/]*)\.[^./]*$", "$1")


def image_results(ocr: DataFrame) -> DataFrame:
    """(doc_id, page_no, img_no, name, text) -> (doc_id, file_no, name, text): a file for each image with a text that is
    not blank, numbered in each document by page and image.

    Pages are counted first, so the running number of a document is summed over its pages, and only the images of one
    page are ordered together. A null name is an empty one.
    """
    told = ocr.filter(F.length(trim_py(F.col("text"))) > 0).select("doc_id", "page_no", "img_no", F.coalesce("name", F.lit("")).alias("image"), "text")
    pages = told.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    pages = pages.select("doc_id", "page_no", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("img_no", "image", "text"))
    rows = told.withColumn("own", own).join(pages, ["doc_id", "page_no"]).withColumn("file_no", F.col("before") + F.col("own"))
    no = F.col("file_no").cast("string")
    page = F.col("page_no").cast("string")
    named = F.when(F.col("image") == "", F.concat(F.lit("image_"), no)).otherwise(stem(F.col("image")))
    head = F.concat(F.lit("图片序号: "), no, F.lit("\n页码: 第"), page, F.lit("页\n原始图片: "), F.col("image"), F.lit("\n" + RULE))
    return rows.select("doc_id", "file_no", F.concat(F.lit("image_"), no, F.lit("_page_"), page, F.lit("_"), named, F.lit(".txt")).alias("name"), F.concat(head, "text").alias("text"))


def table_results(tables: DataFrame) -> DataFrame:
    """(doc_id, table_id, page_no, col_count, row_count, html) -> (doc_id, name, text): a file for each table on one page
    that has content. A null count is 0."""
    t = tables.filter(F.length("html") > 0)
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    head = F.concat(F.lit("表格ID: "), text("table_id"), F.lit("\n页码: 第"), text("page_no"), F.lit("页\n类型: 单页表格\n列数: "), text("col_count"), F.lit("\n行数: "), text("row_count"), F.lit("\n" + RULE))
    return t.select("doc_id", F.concat(F.lit("table_"), text("table_id"), F.lit("_page_"), text("page_no"), F.lit(".txt")).alias("name"), F.concat(head, "html").alias("text"))


def part_results(parts: DataFrame) -> DataFrame:
    """(doc_id, table_id, part_no, page_no, image, html), the parts of tables over pages numbered from 1 -> (doc_id, name,
    text): a file for each part that has content, with how many parts its table has. A null image is an empty name."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "table_id"))
    t = parts.withColumn("n", n).filter(F.length("html") > 0)
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    head = F.concat(F.lit("跨页表格ID: "), c("table_id"), F.lit(" (第"), c("part_no"), F.lit("/"), c("n"), F.lit("部分)\n页码: 第"), c("page_no"), F.lit("页\n原始图片: "), c("image"), F.lit("\n" + RULE))
    return t.select("doc_id", F.concat(F.lit("table_"), c("table_id"), F.lit("_part"), c("part_no"), F.lit("_page_"), c("page_no"), F.lit(".txt")).alias("name"), F.concat(head, "html").alias("text"))


def table_reports(tables: DataFrame) -> DataFrame:
    """(doc_id, table_id, start_page, end_page, page_count, merged_from, col_count, row_count, image, html) -> (doc_id, text):
    one report of all tables of a document, in order of their ids. Counts of 0 or null are left out; a table without
    markup could not be read; one of several pages (page_count) tells which ids it was merged from."""
    wide, thin = "=" * 100, "-" * 100
    c = lambda name: F.col(name).cast("string")
    over = F.coalesce(F.col("page_count") > 1, F.lit(False))
    page = F.concat(c("start_page"), F.when(over, F.concat(F.lit("-"), c("end_page"))).otherwise(""))
    merged = F.concat(F.lit("["), F.array_join(F.transform("merged_from", lambda i: i.cast("string")), ", "), F.lit("]"))
    kind = F.when(over, F.concat(F.lit("类型: 跨页表格 (跨"), c("page_count"), F.lit("页)\n合并自: 表格"), merged, F.lit("\n"))).otherwise("类型: 单页表格\n")
    count = lambda label, name: F.when(F.col(name) > 0, F.concat(F.lit(f"{label}: "), c(name), F.lit("\n"))).otherwise("")
    own = F.concat(F.lit("【表格 "), c("table_id"), F.lit("】\n页码: "), page, F.lit("\n"), kind, count("列数", "col_count"), count("行数", "row_count"), F.lit("图片: "), F.coalesce(c("image"), F.lit("无")), F.lit(f"\n\n识别内容:\n{thin}\n"), F.coalesce(F.nullif("html", F.lit("")), F.lit("(识别失败)")), F.lit(f"\n{thin}\n\n"))
    rows = F.sort_array(F.collect_list(F.struct("table_id", own.alias("text"))))
    return tables.groupBy("doc_id").agg(F.concat(F.lit(f"{wide}\nPDF表格识别结果\n{wide}\n\n"), F.array_join(F.transform(rows, lambda r: r["text"]), "")).alias("text"))


def csv_line(cells: Column) -> Column:
    """Fields joined by commas; those with commas, quotes or line ends are quoted, and so is a lone empty one."""
    field = lambda v: F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    line = F.array_join(F.transform(cells, lambda v: field(F.coalesce(v, F.lit("")))), ",")
    return F.when((F.size(cells) == 1) & (line == ""), '""').otherwise(line)


def sheet_csv(rows: DataFrame) -> DataFrame:
    """Rows of workbooks -> (path, sheet_name, text): each sheet as comma separated values under its columns' names, with
    the mark of UTF-8 in front. Blank rows between others are rows of empty fields; a sheet without columns has a line
    end only."""
    by = ["path", "sheet_no"]
    info = xlsx.sheet_info(rows)
    data = rows.filter("row_no > 1").select(*by, (F.col("row_no") - 2).alias("n"), "cells")
    every = info.filter("n_rows > 0").select(*by, "n_columns", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("n")).join(data, [*by, "n"], "left")
    body = every.select(*by, "n", csv_line(F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda k: F.get("cells", k))).alias("line"))
    lines = info.select(*by, F.lit(-1).alias("n"), csv_line(F.col("column_names")).alias("line")).unionByName(body)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda r: F.concat(r["line"], F.lit("\n"))), "")
    return lines.groupBy(*by).agg(F.concat(F.lit(MARK), text).alias("text")).join(info.select(*by, "sheet_name"), by).select("path", "sheet_name", "text")


def write_texts(files: DataFrame, path: str, by: tuple[str, ...] = ("doc_id", "name")) -> None:
    """Each text as a file of its own under path/doc_id=.../name=.../; executors write, and a lost one's files are written
    again. A line end follows each text, as Spark's writer takes no empty one; a null text is empty."""
    files.select(*by, F.coalesce("text", F.lit("")).alias("text")).write.partitionBy(*by).text(path)
