"""Layout tables derived from the test tables: pages, lines, tables, images, cells and OCR text (see FIXTURES.md)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.python import ready
from . import xlsx


#: Lines, orders and parts that a task makes cells, drawings and pixels of.
LINES, ORDERS, PARTS = 100_000, 30_000, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A table's rows by their keys in parts of about `rows` rows, one a core at least. Rows that a task turns into many
    more are so bounded in number however large the table is; sizes of shuffles, which Spark deals by, don't tell."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *keys)


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): a source is a document, a row a page. Only ids are numbered; texts are joined by id."""
    by = W.partitionBy("source").orderBy("doc_id")
    docs = table(spark, sf_dir, "documents")
    numbered = docs.select("doc_id", "source", F.row_number().over(by).alias("page_no")).withColumnRenamed("doc_id", "id")
    return docs.select(F.col("doc_id").alias("id"), "text").join(numbered, "id").select(F.col("source").alias("doc_id"), "page_no", "text")


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_rows(spark, sf_dir).withColumn("ls", F.split("text", "\n"))
    e = pages.select("doc_id", "page_no", F.size("ls").alias("n"), F.posexplode("ls").alias("pos", "t")).filter(F.trim("t") != "")
    body = e.select("doc_id", "page_no", (F.col("pos") + 1).alias("line_no"), F.trim("t").alias("text"), F.expr("cast(20 + (pos * 800) div n as double)").alias("y0"))
    p = e.select("doc_id", "page_no").distinct()
    title = p.select("doc_id", "page_no", F.lit(0).alias("line_no"), F.concat(F.lit("Report "), "doc_id").alias("text"), F.lit(10.0).alias("y0"))
    number = p.select("doc_id", "page_no", F.lit(100000).alias("line_no"), F.col("page_no").cast("string").alias("text"), F.lit(825.0).alias("y0"))
    out = body.union(title).union(number)
    return out.select("*", F.lit(50.0).alias("x0"), (F.lit(50.0) + 6 * F.least(F.length("text"), F.lit(80))).alias("x1"), (F.col("y0") + 12).alias("y1"))


def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rn"))
    return o.selectExpr(
        "o_custkey doc_id", "rn table_id", "cast(1 + (rn * 7) div 10 as int) page_no", "cast(40 + o_orderkey % 60 as double) x0", "cast(100 + o_orderkey % 500 as double) y0",
        "cast(440 + o_orderkey % 60 + o_orderkey % 50 - (case when o_orderkey % 13 = 0 then 390 else 0 end) as double) x1", "cast(115 + o_orderkey % 500 + o_orderkey % 97 as double) y1",
        "cast(1 + o_orderkey % 7 as int) row_count", "cast(1 + o_orderkey % 5 as int) col_count", "o_orderkey % 11 = 0 text_between",
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_brand doc_id", "p_partkey img_no", "cast(4 + p_size * 25 as int) width", "cast(10 + (p_partkey % 40) * 25 as int) height", "(p_partkey % 100) / 100.0D red_ratio", "cast(1 + p_partkey % 12 as int) page_no")


def numbered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells with `before`, how many characters a table's cells before have; lines are sorted for it, not cells."""
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    texts = [F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.col("l_returnflag")]
    wide = [F.coalesce(F.length(t), F.lit(0)) for t in texts]
    above = F.coalesce(F.sum(sum(wide[1:], wide[0])).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = dealt(table(spark, sf_dir, "lineitem"), LINES, "l_orderkey").withColumns({"row_index": F.row_number().over(by) - 1, "above": above})
    own = F.array(*[F.struct(sum(wide[:k], F.lit(0)).alias("left"), t.alias("text")) for k, t in enumerate(texts)])
    e = rows.select(F.col("l_orderkey").alias("doc_id"), "row_index", "above", (F.col("l_suppkey") % 3).alias("j"), F.posexplode(own).alias("col_index", "own"))
    start = lambda c: F.when(c > 0, 100.0 * c + 0.5 * F.col("j")).otherwise(0.0)
    c = F.col("col_index")
    return e.select("doc_id", "row_index", "col_index", start(c).alias("x_start"), F.when(c < 3, start(c + 1)).otherwise(400.0).alias("x_end"), (20.0 * F.col("row_index")).alias("y_start"), (20.0 * F.col("row_index") + 20).alias("y_end"), "own.text", (F.col("above") + F.col("own.left")).alias("before"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, row_index, col_index, x_start, x_end, y_start, y_end, text): an order is a table, its lines rows."""
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = dealt(table(spark, sf_dir, "lineitem"), LINES, "l_orderkey").withColumn("row_index", F.row_number().over(by) - 1)
    texts = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), F.col("l_returnflag"))
    e = rows.select(F.col("l_orderkey").alias("doc_id"), "row_index", (F.col("l_suppkey") % 3).alias("j"), F.posexplode(texts).alias("col_index", "text"))
    start = lambda c: F.when(c > 0, 100.0 * c + 0.5 * F.col("j")).otherwise(0.0)
    c = F.col("col_index")
    return e.select("doc_id", "row_index", "col_index", start(c).alias("x_start"), F.when(c < 3, start(c + 1)).otherwise(400.0).alias("x_end"), (20.0 * F.col("row_index")).alias("y_start"), (20.0 * F.col("row_index") + 20).alias("y_end"), "text")


def ocr_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page_no, text) pages and (doc_id, page_no, img_no, y0, name, text) OCR: an answer is the text of an image
    on the page before; above it stands one with the answer's start."""
    c = table(spark, sf_dir, "conversations")
    told = c.filter("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), (F.col("turn") - 1).alias("page_no"), "text")
    low = told.select("doc_id", "page_no", F.lit(1).alias("img_no"), F.lit(400.0).alias("y0"), F.lit("low.png").alias("name"), "text")
    high = told.select("doc_id", "page_no", F.lit(2).alias("img_no"), F.lit(100.0).alias("y0"), F.lit("high.png").alias("name"), F.concat(F.lit("> "), F.substring("text", 1, 12)).alias("text"))
    return c.filter("role <> 'assistant'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"), low.union(high)


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, table_id, x0, y0, x1, y1): none, one or two tables on each page of page_rows."""
    p = page_rows(spark, sf_dir).select("doc_id", "page_no", F.explode(F.expr("filter(array(1, 2), k -> k <= page_no % 3)")).alias("table_id"))
    return p.select("doc_id", "page_no", "table_id", F.lit(40.0).alias("x0"), (F.col("table_id") * 200 - 60.0).alias("y0"), F.lit(555.0).alias("x1"), (F.col("table_id") * 200 + 40.0).alias("y1"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layout_lines with each line in two spans, the first ten characters and the rest; ten lines are a block."""
    halves = F.array(F.struct(F.lit(0).alias("span_no"), F.substring("text", 1, 10).alias("t")), F.struct(F.lit(1).alias("span_no"), F.expr("substring(text, 11)").alias("t")))
    e = layout_lines(spark, sf_dir).select("doc_id", "page_no", F.expr("line_no div 10").alias("block_no"), "line_no", "y0", "y1", F.col("x0").alias("left"), F.inline(halves))
    return e.select("doc_id", "page_no", "block_no", "line_no", "span_no", F.col("t").alias("text"), (F.col("left") + 60 * F.col("span_no")).alias("x0"), "y0", (F.col("left") + 60 * F.col("span_no") + 60).alias("x1"), "y1")


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, drawing_no, type, x0, y0, x1, y1, items): on a page for each order a table of up to 4 rows and 5
    columns, drawn line by line. Every other flat line slopes a little. By the order's number, uprights are whole or a
    piece a row; the first two cells of the first row are one; the top is drawn twice, one line first or last; a frame is
    drawn around it; a table of two rows and columns stands below."""
    o = dealt(table(spark, sf_dir, "orders"), ORDERS, "o_custkey").select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rn"))
    o = o.selectExpr("o_custkey doc_id", "cast(rn as int) page_no", "o_orderkey k", "cast(1 + o_orderkey % 4 as int) r", "cast(1 + o_orderkey % 5 as int) c", "cast(100 + o_orderkey % 7 as double) y")
    o = o.withColumn("joint", F.expr("k % 3 = 0 and r > 1 and c > 1"))
    flat = "transform(sequence(0, r), i -> named_struct('no', 10 + i, 'op', 'l', 'x0', 40D, 'y0', y + 30 * i, 'x1', 40D + 60 * c, 'y1', y + 30 * i + 0.4D * (i % 2)))"
    upright = "named_struct('no', 20 + 10 * j + i, 'op', 'l', 'x0', 40D + 60 * j, 'y0', y + 30 * i, 'x1', 40D + 60 * j, 'y1', y + 30 * {})"
    pieces = f"flatten(transform(sequence(0, c), j -> transform(filter(sequence(0, r - 1), i -> not (joint and j = 1 and i = 0)), i -> {upright.format('(i + 1)')})))"
    whole = f"transform(sequence(0, c), j -> transform(array(if(joint and j = 1, 1, 0)), i -> {upright.format('r')})[0])"
    twice = "if(k % 4 = 1, array(named_struct('no', if(k % 8 = 1, 1, 900), 'op', 'l', 'x0', 40D, 'y0', y + 1, 'x1', 40D + 60 * c, 'y1', y + 1)), array())"
    frame = "if(k % 5 = 0, array(named_struct('no', 901, 'op', 're', 'x0', 40D, 'y0', y, 'x1', 40D + 60 * c, 'y1', y + 30 * r)), array())"
    second = "if(k % 6 = 0, concat(transform(sequence(0, 2), i -> named_struct('no', 1000 + i, 'op', 'l', 'x0', 40D, 'y0', 600D + 30 * i, 'x1', 160D, 'y1', 600D + 30 * i)), transform(sequence(0, 2), j -> named_struct('no', 1010 + j, 'op', 'l', 'x0', 40D + 60 * j, 'y0', 600D, 'x1', 40D + 60 * j, 'y1', 660D))), array())"
    e = o.select("doc_id", "page_no", F.expr(f"inline(concat({flat}, if(k % 2 = 0, {whole}, {pieces}), {twice}, {frame}, {second}))"))
    return e.selectExpr("doc_id", "page_no", "cast(no as bigint) drawing_no", "'s' type", "x0", "y0", "x1", "y1", "array(named_struct('op', op, 'x0', x0, 'y0', y0, 'x1', x1, 'y1', y1)) items")


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a workbook for each brand of part, with a sheet for each size that its parts have, of their keys,
    names and types, and one without rows."""
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_type")))
    sheets = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(rows.alias("rows")).groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_size", "rows"))).alias("sheets"))
    ready(spark)

    def write(batches):
        for b in batches:
            made = [xlsx.workbook([*((f"size {s['p_size']}", [["key", "name", "type"], *(list(r.values()) for r in s["rows"])]) for s in sheets), ("none", [["key"]])]) for sheets in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return sheets.select(F.concat("p_brand", F.lit(".xlsx")).alias("path"), "sheets").mapInArrow(write, "path string, content binary")


def stamp_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, img_no, width, height, rgb) of part: an image for each part, in stripes that its type gives."""
    size = dealt(table(spark, sf_dir, "part"), PARTS, "p_partkey").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("img_no"), (F.lit(30) + F.col("p_size")).cast("int").alias("width"), (F.lit(40) + F.col("p_partkey") % 37).cast("int").alias("height"), "p_type")
    # a stripe is hashed once for its eight rows
    row = lambda k: F.substring(F.repeat(F.sha2(F.concat(F.col("p_type"), k.cast("string")), 256), 8), F.lit(1), F.col("width") * 6)
    stripes = F.transform(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / 8).cast("int")), lambda k: F.repeat(row(k), F.least(F.lit(8), F.col("height") - 8 * k)))
    return size.select("doc_id", "img_no", "width", "height", F.unhex(F.array_join(stripes, "")).alias("rgb"))
