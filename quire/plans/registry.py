"""Every registered query of the layout engine and its SQL twin, on layout tables derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as txt
from ..operators import assemble, lattice, markup, merge, row_merge, rows, spans, stamps, tables, text
from ..operators import images as img
from ..sinks import text as files
from ..sources import layout, xlsx

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

P = """p AS (SELECT source AS doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_no, text, string_split(text, chr(10)) AS ls FROM documents)"""
D1 = f"""{P}, e AS (SELECT doc_id, page_no, len(ls) AS n, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS pos FROM p),
b AS (SELECT * FROM e WHERE trim(t) <> ''),
l AS (SELECT *, 50.0::DOUBLE AS x0, CAST(50 + 6 * least(length(text), 80) AS DOUBLE) AS x1, y0 + 12 AS y1 FROM (
 SELECT doc_id, page_no, CAST(pos + 1 AS INT) AS line_no, trim(t) AS text, CAST(20 + (pos * 800) // n AS DOUBLE) AS y0 FROM b
 UNION ALL SELECT DISTINCT doc_id, page_no, 0, 'Report ' || doc_id, 10.0::DOUBLE FROM b
 UNION ALL SELECT DISTINCT doc_id, page_no, 100000, CAST(page_no AS VARCHAR), 825.0::DOUBLE FROM b)),
r AS (SELECT *, CASE WHEN y0 < 842 * 0.15 THEN 'header' WHEN y1 > 842 * 0.85 THEN 'footer' END AS region FROM l),
c AS (SELECT doc_id, region, text, count(DISTINCT page_no) AS pages FROM r WHERE region IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page_no) >= 2)"""
D2 = """o AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS rn FROM orders),
t AS (SELECT o_custkey AS doc_id, rn AS table_id, CAST(1 + (rn * 7) // 10 AS INT) AS page_no, CAST(40 + o_orderkey % 60 AS DOUBLE) AS x0, CAST(100 + o_orderkey % 500 AS DOUBLE) AS y0,
 CAST(440 + o_orderkey % 60 + o_orderkey % 50 - (CASE WHEN o_orderkey % 13 = 0 THEN 390 ELSE 0 END) AS DOUBLE) AS x1, CAST(115 + o_orderkey % 500 + o_orderkey % 97 AS DOUBLE) AS y1,
 CAST(1 + o_orderkey % 7 AS INT) AS row_count, CAST(1 + o_orderkey % 5 AS INT) AS col_count, o_orderkey % 11 = 0 AS text_between FROM o)"""
LOOSE = "row_count >= 1 AND x1 - x0 >= 30 AND y1 - y0 >= 10"
STRICT = "row_count >= 1 AND col_count >= 2 AND x1 - x0 >= 80 AND y1 - y0 >= 20 AND NOT (row_count = 1 AND col_count <= 2 AND x1 - x0 > 400)"
D2C = f"""{D2}, g AS (SELECT *, coalesce(page_no - lag(page_no) OVER w = 1 AND NOT lag(text_between) OVER w AND abs(x0 - lag(x0) OVER w) <= 20
 AND least(x1 - x0, lag(x1) OVER w - lag(x0) OVER w) / greatest(x1 - x0, lag(x1) OVER w - lag(x0) OVER w) >= 0.9, false) AS go FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY table_id)),
k AS (SELECT * EXCLUDE go, CAST(sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY table_id) AS BIGINT) AS island FROM g)"""
D2S = f"""{D2C}, u AS (SELECT doc_id, island, count(*) AS page_count, min(page_no) AS start_page, max(page_no) AS end_page, CAST(sum(row_count) AS BIGINT) AS row_count, min_by(x0, table_id) AS x0, min_by(y0, table_id) AS y0,
 min_by(x1, table_id) AS x1, min_by(y1, table_id) AS y1, min_by(col_count, table_id) AS col_count, min(table_id) AS table_id FROM k GROUP BY ALL),
s AS (SELECT * EXCLUDE alone FROM (SELECT *, sum(page_count) OVER (PARTITION BY doc_id) = 1 AS alone FROM u) WHERE page_count > 1 OR alone OR ({STRICT}))"""
D4 = """q AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS row_index FROM lineitem),
z AS (SELECT l_orderkey AS doc_id, row_index, c AS col_index, CASE WHEN c > 0 THEN 100.0 * c + 0.5 * (l_suppkey % 3) ELSE 0.0 END::DOUBLE AS x_start, CASE WHEN c < 3 THEN 100.0 * (c + 1) + 0.5 * (l_suppkey % 3) ELSE 400.0 END::DOUBLE AS x_end,
 20.0::DOUBLE * row_index AS y_start, 20.0::DOUBLE * row_index + 20 AS y_end,
 CASE c WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN CAST(l_suppkey AS VARCHAR) WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE l_returnflag END AS text FROM q, (SELECT unnest([0, 1, 2, 3]) AS c))"""
D5 = """pg AS (SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations WHERE role <> 'assistant'),
im AS (SELECT conv_id AS doc_id, turn - 1 AS page_no, 1 AS img_no, 400 AS y0, 'low.png' AS name, text FROM conversations WHERE role = 'assistant'
 UNION ALL SELECT conv_id, turn - 1, 2, 100, 'high.png', '> ' || text[1:12] FROM conversations WHERE role = 'assistant'),
oc AS (SELECT doc_id, page_no, string_agg(coalesce(text, ''), chr(10) ORDER BY y0, img_no, name, coalesce(text, '')) AS ocr,
 string_agg(chr(10) || '[图片: ' || name || ']' || chr(10) || coalesce(text, ''), chr(10) ORDER BY y0, img_no, name, coalesce(text, '')) AS items FROM im GROUP BY ALL),
j AS (SELECT pg.doc_id, pg.page_no, coalesce(pg.text, '') AS text, pg.text AS raw, ocr, items FROM pg LEFT JOIN oc USING (doc_id, page_no))"""
NUM = r"regexp_full_match({0}, '\s*(第\s*\d+\s*页|\d+)\s*')"


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


@query("paginate_lines", f"WITH {P} SELECT doc_id, page_no, len(ls) AS n_lines, length(text) AS n_chars FROM p WHERE trim(text) <> ''")
def paginate_lines(s, d):
    return layout.page_rows(s, d).filter(txt.trim_py(F.col("text")) != "").select("doc_id", "page_no", F.size(F.split("text", "\n")).alias("n_lines"), F.length("text").alias("n_chars"))


@query("line_regions", f"WITH {D1} SELECT doc_id, page_no, line_no, text, y0, y1, region FROM r")
def line_regions(s, d):
    return text.line_regions(layout.layout_lines(s, d)).select("doc_id", "page_no", "line_no", "text", "y0", "y1", "region")


@query("common_headers_footers", f"WITH {D1} SELECT * FROM c")
def common_headers_footers(s, d):
    return text.common_texts(layout.layout_lines(s, d))


@query("clean_pages_by_position", f"WITH {D1} SELECT r.doc_id, page_no, string_agg(r.text, chr(10) ORDER BY line_no) AS text FROM r LEFT JOIN c ON r.doc_id = c.doc_id AND r.region = c.region AND r.text = c.text WHERE c.doc_id IS NULL AND NOT (r.region IS NOT NULL AND {NUM.format('r.text')}) GROUP BY ALL")
def clean_pages_by_position(s, d):
    return text.clean_pages(layout.layout_lines(s, d))


def _numbered(s, d):
    """Page texts with numbers at the edges and one inside, and blank lines."""
    return layout.page_rows(s, d).withColumn("text", F.concat(F.col("page_no").cast("string"), F.lit("\n第 3 页\n"), "text", F.lit("\n12\n\n \n\ntail\n"), F.col("page_no").cast("string")))


NUMBERED = f"{P}, n AS (SELECT doc_id, page_no, page_no || chr(10) || '第 3 页' || chr(10) || text || chr(10) || '12' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || 'tail' || chr(10) || page_no AS text FROM p)"
EDGE = f"{NUMBERED}, x AS (SELECT doc_id, page_no, string_split(text, chr(10)) AS ls FROM n), y AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: NOT {NUM.format('ls[i]')}) AS ok FROM x)"


@query("strip_edge_page_numbers", f"WITH {EDGE} SELECT doc_id, page_no, array_to_string(ls[ok[1]:ok[-1]], chr(10)) AS text FROM y")
def strip_edge_page_numbers(s, d):
    return _numbered(s, d).select("doc_id", "page_no", txt.strip_edge_page_numbers(F.col("text")).alias("text"))


@query("clean_text_lines", f"WITH {EDGE} SELECT doc_id, page_no, trim(array_to_string(list_filter(ls[ok[1]:ok[-1]], lambda v: NOT {NUM.format('v')}), chr(10)), chr(10) || ' ') AS text FROM y")
def clean_text_lines(s, d):
    return _numbered(s, d).select("doc_id", "page_no", txt.clean_text(F.col("text")).alias("text"))


@query("remove_simple", f"WITH {NUMBERED}, x AS (SELECT doc_id, page_no, string_split(text, chr(10)) AS ls FROM n) SELECT doc_id, page_no, trim(array_to_string(CASE WHEN regexp_full_match(trim(ls[3]), '\\d{{1,4}}') THEN ls[4:] ELSE ls[3:] END, chr(10)), chr(10) || ' ') AS text FROM x")
def remove_simple(s, d):
    return _numbered(s, d).select("doc_id", "page_no", txt.remove_simple(F.col("text")).alias("text"))


@query("collapse_blank_lines", f"WITH {NUMBERED}, x AS (SELECT doc_id, page_no, string_split(text, chr(10)) AS ls FROM n) SELECT doc_id, page_no, array_to_string([ls[i] for i in range(1, len(ls) + 1) if trim(ls[i]) <> '' OR i = 1 OR trim(ls[i - 1]) <> ''], chr(10)) AS text FROM x")
def collapse_blank_lines(s, d):
    return _numbered(s, d).select("doc_id", "page_no", txt.collapse_blank_lines(F.col("text")).alias("text"))


@query("split_page_markers", "SELECT doc_id, 1 AS page_no, trim(text, chr(10) || ' ') AS text FROM documents UNION ALL SELECT doc_id, 2, source FROM documents")
def split_page_markers(s, d):
    t = F.concat(F.lit("lead==第1页==\n"), "text", F.lit("\n==第2页==\nold\n==第2页==\n"), "source")
    return layout.table(s, d, "documents").select("doc_id", F.inline(txt.split_pages(t)))


def _typed(s, d):
    return layout.page_rows(s, d).withColumn("has_image", F.col("page_no") % 3 == 0)


D7 = f"{P}, i AS (SELECT doc_id, page_no, text, page_no % 3 = 0 AS has_image FROM p)"
TYPE = f"{D7}, ty AS (SELECT doc_id, CASE WHEN a > b THEN 'text' WHEN b > a THEN 'scanned' ELSE 'mixed' END AS type FROM (SELECT doc_id, count(*) FILTER (length(trim(text, chr(10) || ' ')) > 100) AS a, count(*) FILTER (length(trim(text, chr(10) || ' ')) <= 100 AND has_image) AS b FROM i WHERE page_no <= 3 GROUP BY 1))"
STRUCT = "st AS (SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, bool_or(has_image) AS has_images, count(*) FILTER (has_image) AS image_pages, count(*) FILTER (trim(text, chr(10) || ' ') = '') AS blank_pages FROM i GROUP BY 1)"


@query("pdf_type", f"WITH {TYPE} SELECT * FROM ty")
def pdf_type(s, d):
    return merge.document_type(_typed(s, d))


@query("structure_summary", f"WITH {D7}, {STRUCT} SELECT * FROM st")
def structure_summary(s, d):
    return merge.structure(_typed(s, d))


@query("recommend_mode", f"WITH {TYPE}, {STRUCT} SELECT doc_id, type, CASE WHEN type = 'text' AND NOT has_images THEN 'coarse' ELSE 'complete' END AS mode, CASE WHEN type = 'text' AND NOT has_images THEN 'text only' WHEN type = 'scanned' THEN 'scanned' ELSE 'images' END AS reason FROM ty JOIN st USING (doc_id)")
def recommend_mode(s, d):
    return merge.recommended(merge.document_type(_typed(s, d)), merge.structure(_typed(s, d)))


_OWN = "CASE WHEN trim(text, chr(10) || ' ') <> '' THEN text END"
_BANNER = "CASE WHEN items IS NOT NULL THEN chr(10) || '[图片OCR结果]' END"
_MERGED = {
    "append": f"{_OWN}, {_BANNER}, items",
    "replace": f"CASE WHEN length(trim(text, chr(10) || ' ')) < 50 AND items IS NOT NULL THEN '[使用图片OCR结果]' ELSE text END, CASE WHEN length(trim(text, chr(10) || ' ')) >= 50 THEN {_BANNER} END, items",
    "interleave": f"{_OWN}, items",
}
MARKED = "concat_ws(chr(10), '==第' || page_no || '页==', {0}, '')"
for _k, _v in _MERGED.items():
    query(f"merge_{_k}", f"WITH {D5} SELECT doc_id, page_no, {MARKED.format(_v)} AS text FROM j")(lambda s, d, k=_k: merge.joined(*layout.ocr_pages(s, d)).select("doc_id", "page_no", merge.merged(k).alias("text")))


@query("ocr_left_join", f"WITH {D5} SELECT doc_id, page_no, raw AS text, coalesce(ocr, '') AS ocr FROM j")
def ocr_left_join(s, d):
    return merge.joined(*layout.ocr_pages(s, d)).select("doc_id", "page_no", "text", merge.ocr_text(F.col("images")).alias("ocr"))


@query("merge_documents", f"WITH {D5} SELECT doc_id, string_agg({MARKED.format(_MERGED['append'])}, chr(10) ORDER BY page_no, text) AS text FROM j GROUP BY 1")
def merge_documents(s, d):
    return merge.merged_documents(*layout.ocr_pages(s, d))


_WHOLE = f"{D5}, w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no, text) AS text FROM j GROUP BY 1)"


def _whole(s, d):
    return merge.in_order(layout.ocr_pages(s, d)[0].withColumn("text", F.coalesce("text", F.lit(""))), "page_no")


@query("merge_simple", f"WITH {_WHOLE}, r AS (SELECT doc_id, string_agg('[图片: ' || name || ']' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY page_no, y0, img_no, name, coalesce(text, '')) AS items FROM im GROUP BY 1) SELECT w.doc_id, concat_ws(chr(10), CASE WHEN text <> '' THEN text || chr(10) END, CASE WHEN items IS NOT NULL THEN repeat('=', 50) || chr(10) || '图片OCR识别结果' || chr(10) || repeat('=', 50) || chr(10) END, items) AS text FROM w LEFT JOIN r USING (doc_id)")
def merge_simple(s, d):
    return merge.simply_merged(_whole(s, d), layout.ocr_pages(s, d)[1])


@query("merge_with_sections", "SELECT string_agg(repeat('=', 50) || chr(10) || 'part ' || doc_id || chr(10) || repeat('=', 50) || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY doc_id) AS text, source AS doc_id FROM documents GROUP BY source")
def merge_with_sections(s, d):
    t = layout.table(s, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("no"), merge.section(F.concat(F.lit("part "), F.col("doc_id").cast("string")), F.col("text")).alias("text"))
    return merge.in_order(t, "no")


@query("merge_multiple_files", "SELECT string_agg(repeat('=', 60) || chr(10) || '文件: ' || doc_id || chr(10) || repeat('=', 60) || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY doc_id) AS text, source AS doc_id FROM documents GROUP BY source")
def merge_multiple_files(s, d):
    t = layout.table(s, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("no"), merge.section(F.concat(F.lit(merge.FILE), F.col("doc_id").cast("string")), F.col("text"), 60).alias("text"))
    return merge.in_order(t, "no")


@query("format_with_metadata", "SELECT doc_id, repeat('=', 60) || chr(10) || '文件元数据' || chr(10) || repeat('=', 60) || chr(10) || 'lang: ' || coalesce(lang, '') || chr(10) || 'source: ' || coalesce(source, '') || chr(10) || repeat('=', 60) || chr(10) || chr(10) || coalesce(text, '') AS text FROM documents")
def format_with_metadata(s, d):
    pair = lambda k: F.struct(F.lit(k).alias("key"), F.col(k).alias("value"))
    return layout.table(s, d, "documents").select("doc_id", merge.with_metadata(F.array(pair("lang"), pair("source")), F.col("text")).alias("text"))


@query("merge_with_page_info", f"WITH {P} SELECT doc_id, string_agg('==第' || page_no || '页==' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY page_no) AS text FROM p GROUP BY 1")
def merge_with_page_info(s, d):
    return merge.in_order(layout.page_rows(s, d).select("doc_id", "page_no", merge.with_page_info(F.col("page_no"), F.col("text")).alias("text")), "page_no")


@query("document_text", f"WITH {P} SELECT doc_id, string_agg('==第' || page_no || '页==' || chr(10) || trim(text, chr(10) || ' ') || chr(10), chr(10) ORDER BY page_no) AS text FROM p WHERE trim(text, chr(10) || ' ') <> '' GROUP BY 1")
def document_text(s, d):
    return text.page_text(layout.page_rows(s, d))


@query("page_details", f"WITH {P} SELECT doc_id, page_no, coalesce(text, '') AS text, trim(coalesce(text, ''), chr(10) || ' ') <> '' AS has_text FROM p")
def page_details(s, d):
    return text.page_details(layout.page_rows(s, d))


@query("lines_of_spans", f"WITH {D1} SELECT doc_id, page_no, CAST(line_no // 10 AS BIGINT) AS block_no, line_no, text, x0, y0, x0 + 60 AS x1, y1 FROM l")
def lines_of_spans(s, d):
    return text.lines_of_spans(layout.spans(s, d))


@query("text_blocks", f"WITH {D1}, k AS (SELECT doc_id, page_no, CAST(line_no // 10 AS BIGINT) AS block_no, string_agg(text, '' ORDER BY line_no) AS text, min(y0) AS y0, max(y1) AS y1 FROM l GROUP BY ALL) SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = k.doc_id AND c.text = trim(k.text))")
def text_blocks(s, d):
    return text.text_blocks(layout.spans(s, d), text.common_texts(layout.layout_lines(s, d)))


@query("blocks_of_body", f"WITH {D1}, k AS (SELECT doc_id, page_no, line_no // 10 AS block_no, string_agg(text, '' ORDER BY line_no) AS text, min(y0) AS y0, max(y1) AS y1 FROM l GROUP BY ALL) SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY y0, block_no) AS text FROM k WHERE y0 >= 842 * 0.15 - 5 AND y1 <= 842 * 0.85 + 5 GROUP BY ALL")
def blocks_of_body(s, d):
    lines = layout.layout_lines(s, d).select("doc_id", "page_no", F.expr("line_no div 10").alias("block_no"), "line_no", "text", "y0", "y1")
    rows_ = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return text.blocks_of_body(lines.groupBy("doc_id", "page_no", "block_no").agg(F.array_join(F.transform(rows_, lambda r: r["text"]), "").alias("text"), F.min("y0").alias("y0"), F.max("y1").alias("y1")))


def _boxes(s, d):
    """Boxes near the tables of each document: shifted by an amount that depends on the table."""
    t = layout.layout_tables(s, d)
    move = (F.col("table_id") * 37 % 120).cast("double")
    return t.select("doc_id", "page_no", (F.col("doc_id") * 1000 + F.col("table_id")).alias("box_id"), (F.col("x0") + move).alias("x0"), (F.col("y0") + move).alias("y0"), (F.col("x1") + move).alias("x1"), (F.col("y1") + move).alias("y1"))


BOXES = f"{D2}, bx AS (SELECT doc_id, page_no, doc_id * 1000 + table_id AS box_id, x0 + (table_id * 37 % 120) AS x0, y0 + (table_id * 37 % 120) AS y0, x1 + (table_id * 37 % 120) AS x1, y1 + (table_id * 37 % 120) AS y1 FROM t)"
OVER = "(CASE WHEN least(a.x1, t.x1) <= greatest(a.x0, t.x0) OR least(a.y1, t.y1) <= greatest(a.y0, t.y0) OR least((a.x1 - a.x0) * (a.y1 - a.y0), (t.x1 - t.x0) * (t.y1 - t.y0)) <= 0 THEN 0.0 ELSE (least(a.x1, t.x1) - greatest(a.x0, t.x0)) * (least(a.y1, t.y1) - greatest(a.y0, t.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (t.x1 - t.x0) * (t.y1 - t.y0)) END)"


@query("bbox_overlap", f"WITH {BOXES} SELECT box_id, table_id, round({OVER}, 6) AS ratio FROM bx a JOIN t USING (doc_id, page_no)")
def bbox_overlap(s, d):
    t = layout.layout_tables(s, d).select("doc_id", "page_no", "table_id", *[F.col(c).alias(f"t_{c}") for c in geo.BOX])
    return _boxes(s, d).join(t, ["doc_id", "page_no"]).select("box_id", "table_id", F.round(geo.overlap_ratio(geo.box(), geo.box("t_")), 6).alias("ratio"))


@query("box_antijoin", f"WITH {BOXES} SELECT box_id FROM bx a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = a.doc_id AND t.page_no = a.page_no AND {OVER} > 0.3)")
def box_antijoin(s, d):
    return tables.box_antijoin(_boxes(s, d), layout.layout_tables(s, d)).select("box_id")


DIST = "sqrt(pow((a.x0 + a.x1) / 2 - (t.x0 + t.x1) / 2, 2) + pow((a.y0 + a.y1) / 2 - (t.y0 + t.y1) / 2, 2))"


@query("nearest_table", f"WITH {BOXES} SELECT box_id, table_id, round(dist, 4) AS distance FROM (SELECT box_id, table_id, {DIST} AS dist FROM bx a JOIN t USING (doc_id, page_no) WHERE {OVER} > 0.3 OR {DIST} < 50) QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY dist, table_id) = 1")
def nearest_table(s, d):
    return tables.nearest_table(_boxes(s, d), layout.layout_tables(s, d))


@query("valid_tables_loose", f"WITH {D2} SELECT doc_id, table_id FROM t WHERE {LOOSE}")
def valid_tables_loose(s, d):
    return tables.valid_tables(layout.layout_tables(s, d), False).select("doc_id", "table_id")


@query("valid_tables_strict", f"WITH {D2} SELECT doc_id, table_id FROM t WHERE {STRICT}")
def valid_tables_strict(s, d):
    return tables.valid_tables(layout.layout_tables(s, d), True).select("doc_id", "table_id")


@query("cross_page_pairs", f"WITH {D2C} SELECT doc_id, table_id FROM g WHERE go")
def cross_page_pairs(s, d):
    t = layout.layout_tables(s, d)
    return t.withColumn("go", tables.follows()).filter("go").select("doc_id", "table_id")


@query("cross_page_chains", f"WITH {D2C} SELECT doc_id, table_id, island FROM k")
def cross_page_chains(s, d):
    return tables.chains(layout.layout_tables(s, d)).select("doc_id", "table_id", "island")


@query("cross_page_summary", f"WITH {D2S} SELECT * FROM s")
def cross_page_summary(s, d):
    return tables.chain_summary(tables.chains(layout.layout_tables(s, d)))


@query("covered_pages", f"WITH {D2S}, v AS (SELECT doc_id, table_id, unnest(range(start_page + 1, end_page + 1)) AS page_no FROM s WHERE start_page < end_page) SELECT doc_id, CAST(page_no AS INT) AS page_no, max(table_id) AS table_id FROM v GROUP BY ALL")
def covered_pages(s, d):
    return tables.covered_pages(tables.chain_summary(tables.chains(layout.layout_tables(s, d))))


@query("doc_statistics", f"WITH {D2S} SELECT doc_id, count(*) AS tables, count(*) FILTER (page_count > 1) AS cross_page, count(*) - count(*) FILTER (page_count > 1) AS single FROM s GROUP BY 1")
def doc_statistics(s, d):
    n = tables.chain_summary(tables.chains(layout.layout_tables(s, d))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables"), F.count_if(F.col("page_count") > 1).alias("cross_page"))
    return n.withColumn("single", F.col("tables") - F.col("cross_page"))


@query("row_col_counts", f"WITH {D4} SELECT doc_id, count(DISTINCT row_index) AS n_rows, count(DISTINCT col_index) AS n_cols, max(x_end) AS x_end, max(y_end) AS y_end FROM z GROUP BY 1")
def row_col_counts(s, d):
    # a table bounds its rows and columns; sets of them take no shuffle, and no three rows for each cell
    kinds = lambda c: F.size(F.collect_set(c)).cast("long")
    return layout.cells(s, d).groupBy("doc_id").agg(kinds("row_index").alias("n_rows"), kinds("col_index").alias("n_cols"), F.max("x_end").alias("x_end"), F.max("y_end").alias("y_end"))


@query("cell_grid", f"WITH {D4} SELECT doc_id, row_index, max(y_end) AS y_end, max(y_end) - min(y_start) AS height, count(*) AS col_count, string_agg(text, '|' ORDER BY col_index) AS texts FROM z GROUP BY ALL")
def cell_grid(s, d):
    g = layout.cells(s, d).groupBy("doc_id", "row_index")
    return g.agg(F.max("y_end").alias("y_end"), (F.max("y_end") - F.min("y_start")).alias("height"), F.count(F.lit(1)).alias("col_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "text"))), lambda c: c["text"]), "|").alias("texts"))


_FOLD = "list_reduce([[x] for x in xs], lambda a, b: CASE WHEN b[1] - a[-1] >= 2.0 THEN list_concat(a, b) ELSE list_concat(a[1:len(a) - 1], [(a[-1] + b[1]) / 2]) END)"


@query("merged_vertical_lines", f"WITH {D4}, xs AS (SELECT doc_id, list_sort(list_distinct(list(x_start))) AS xs FROM z GROUP BY 1) SELECT doc_id, array_to_string([CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR) for v in {_FOLD}], ',') AS lines FROM xs")
def merged_vertical_lines(s, d):
    xs = layout.cells(s, d).groupBy("doc_id").agg(F.collect_set("x_start").alias("xs"))
    return xs.select("doc_id", F.array_join(F.transform(geo.merge_coords(F.col("xs"), 2.0), lambda v: F.round(v * 1000).cast("long").cast("string")), ",").alias("lines"))


@query("column_vote", f"WITH {D4}, m AS (SELECT doc_id, row_index AS row_no, 4 - (doc_id + row_index) % 3 AS cols FROM z WHERE col_index = 0), k AS (SELECT doc_id, cols, count(*) AS n, min(row_no) AS f FROM m GROUP BY ALL), a AS (SELECT doc_id, sum(n) AS rows_, count(*) AS kinds, max(cols) AS most, first(cols ORDER BY n DESC, f) AS mode, max(n) AS mode_n, max_by(n, cols) AS most_n FROM k GROUP BY 1) SELECT doc_id, CASE WHEN kinds = 1 THEN most WHEN mode_n / rows_ > 0.6 THEN mode WHEN most_n / rows_ > 0.3 THEN most WHEN most - mode <= 1 THEN most ELSE mode END AS cols FROM a")
def column_vote(s, d):
    m = layout.cells(s, d).filter("col_index = 0").select("doc_id", F.col("row_index").alias("row_no"), (4 - (F.col("doc_id") + F.col("row_index")) % 3).alias("cols"))
    return tables.column_vote(m)


def _all_chars(s, d):
    """Every character of every cell with its own box, on two lines whose tops are up to 1.5 apart."""
    # split parts by code points, but makes one of an empty text
    c = layout.numbered_cells(s, d).select("doc_id", "x_start", "y_start", "before", F.ceil(F.length("text") / 2).alias("wide"), F.posexplode(F.when(F.col("text") != "", F.split("text", ""))).alias("k", "c"))
    at = F.col("k") % F.col("wide")
    x0 = F.col("x_start") + 5 + 80.0 * at / F.col("wide")
    y0 = F.col("y_start") + 3 + F.when(F.col("k") >= F.col("wide"), 8.0).otherwise(0.0) + 0.75 * (at % 3)
    return c.select("doc_id", (F.col("before") + F.col("k")).cast("long").alias("char_no"), "c", x0.alias("x0"), y0.alias("y0"), (x0 + 60.0 / F.col("wide")).alias("x1"), (y0 + 5).alias("y1"))


@query("char_to_cell", f"WITH {D4}, w AS (SELECT doc_id, row_index, col_index, text, unnest(range(1, length(text) + 1)) AS k FROM z) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_index, col_index, k) - 1 AS char_no, text[k:k] AS c, row_index, col_index FROM w")
def char_to_cell(s, d):
    return tables.char_to_cell(tables.chars_in_tables(_all_chars(s, d), layout.cells(s, d)), layout.cells(s, d)).select("doc_id", "char_no", "c", "row_index", "col_index")


@query("cell_text", f"WITH {D4} SELECT doc_id, row_index, col_index, CASE WHEN length(text) = 1 THEN text ELSE text[:(length(text) + 1) // 2] || '<br>' || text[(length(text) + 1) // 2 + 1:] END AS text FROM z WHERE text <> ''")
def cell_text(s, d):
    return tables.text_in_cells(tables.chars_in_tables(_all_chars(s, d), layout.cells(s, d)), layout.cells(s, d))


@query("colspan_rowspan", f"WITH {D4}, xs AS (SELECT doc_id, list(DISTINCT x_start) AS xs, list(DISTINCT y_start) AS ys FROM z GROUP BY 1), w AS (SELECT doc_id, row_index, col_index, x_start, CASE WHEN col_index = 1 THEN x_end + 100 ELSE x_end END AS x_end, y_start, y_end + 20 * (row_index % 2) AS y_end FROM z) SELECT doc_id, row_index, col_index, CAST(1 + len(list_filter(list_distinct([round(x / 100) * 100 for x in xs]), lambda v: v > x_start + 2 AND v < x_end - 2)) AS INT) AS colspan, CAST(1 + len(list_filter(ys, lambda v: v > y_start + 2 AND v < y_end - 2)) AS INT) AS rowspan FROM w JOIN xs USING (doc_id)")
def colspan_rowspan(s, d):
    c = layout.cells(s, d)
    lines = c.groupBy("doc_id").agg(F.array_distinct(F.transform(F.collect_set("x_start"), lambda x: F.round(x / 100) * 100)).alias("xs"), F.collect_set("y_start").alias("ys"))
    wide = c.withColumn("x_end", F.when(F.col("col_index") == 1, F.col("x_end") + 100).otherwise(F.col("x_end"))).withColumn("y_end", F.col("y_end") + 20 * (F.col("row_index") % 2)).join(lines, "doc_id")
    return tables.spans(wide, F.col("xs"), F.col("ys")).select("doc_id", "row_index", "col_index", "colspan", "rowspan")


SPANNED = f"{D4}, m AS (SELECT doc_id, row_index AS row_no, col_index, CAST(1 + (row_index + col_index) % 2 AS INT) AS colspan, CASE WHEN col_index = 0 AND row_index % 2 = 0 THEN 2 ELSE 1 END AS rowspan FROM z), dc AS (SELECT a.doc_id, a.row_no, CAST(a.own + coalesce(sum(b.colspan), 0) AS INT) AS cols FROM (SELECT doc_id, row_no, sum(colspan) AS own FROM m GROUP BY ALL) a LEFT JOIN m b ON b.doc_id = a.doc_id AND b.row_no < a.row_no AND b.row_no + b.rowspan > a.row_no GROUP BY a.doc_id, a.row_no, a.own)"


def _display(s, d):
    c = layout.cells(s, d).select("doc_id", F.col("row_index").alias("row_no"), F.col("col_index").alias("cell_no"), (1 + (F.col("row_index") + F.col("col_index")) % 2).cast("int").alias("colspan"), F.when((F.col("col_index") == 0) & (F.col("row_index") % 2 == 0), 2).otherwise(1).alias("rowspan"))
    return tables.display_columns(c)


@query("display_columns", f"WITH {SPANNED} SELECT * FROM dc")
def display_columns(s, d):
    return _display(s, d)


@query("columns_shown", f"WITH {SPANNED}, k AS (SELECT doc_id, cols, count(*) AS n, min(row_no) AS f FROM dc GROUP BY ALL), a AS (SELECT doc_id, sum(n) AS r, max(cols) AS most, max_by(n, cols) AS most_n, first(cols ORDER BY n DESC, f) AS mode FROM k GROUP BY 1) SELECT doc_id, CASE WHEN most_n / r > 0.3 THEN most ELSE mode END AS cols FROM a")
def columns_shown(s, d):
    return tables.columns_shown(_display(s, d))


@query("expected_columns", f"WITH {SPANNED}, tt AS (SELECT DISTINCT doc_id, CAST(doc_id % 9 AS INT) AS col_count FROM z) SELECT tt.doc_id, coalesce(nullif(max(cols) FILTER (row_no BETWEEN 1 AND 4 OR row_no = 0), 0), nullif(any_value(col_count), 0), nullif(max(cols), 0)) AS cols FROM tt LEFT JOIN dc USING (doc_id) GROUP BY 1")
def expected_columns(s, d):
    t = layout.cells(s, d).select("doc_id").distinct().withColumn("col_count", (F.col("doc_id") % 9).cast("int"))
    return tables.expected_columns(_display(s, d), t)


@query("effective_columns", f"WITH {D4}, x AS (SELECT doc_id, row_index, list(CASE WHEN (doc_id + col_index) % 3 = 0 THEN ' ' ELSE text END ORDER BY col_index) AS ts FROM z GROUP BY ALL) SELECT doc_id, row_index, CAST(CASE WHEN len(list_filter(ts, lambda t: trim(t) <> '')) = 0 THEN len(ts) ELSE len(list_filter(ts, lambda t: trim(t) <> '')) END AS INT) AS cols FROM x")
def effective_columns(s, d):
    t = F.when((F.col("doc_id") + F.col("col_index")) % 3 == 0, " ").otherwise(F.col("text"))
    g = layout.cells(s, d).groupBy("doc_id", "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_index", t.alias("t")))), lambda c: c["t"]).alias("ts"))
    return g.select("doc_id", "row_index", tables.effective_columns(F.col("ts")).alias("cols"))


def _spanned_cells(s, d):
    """layout.cells with cells over two rows in column 0, over two columns in column 1, gaps in column 2, and texts with
    what is escaped."""
    c = layout.cells(s, d).withColumn("last", F.max("row_index").over(W.partitionBy("doc_id")))
    wide = (F.col("row_index") > 0) & ((F.col("doc_id") + F.col("row_index")) % 4 == 3)
    c = c.filter(~((F.col("col_index") == 0) & (F.col("row_index") % 2 == 1)) & ~((F.col("col_index") == 2) & (wide | (F.col("row_index") % 3 == 1))))
    high = (F.col("col_index") == 0) & (F.col("row_index") < F.col("last"))
    text = F.concat("text", F.when(F.col("row_index") % 2 == 0, F.lit('<br>&"<')).otherwise(""))
    return c.select("doc_id", "row_index", "col_index", "x_start", F.when(wide & (F.col("col_index") == 1), F.col("x_end") + 100).otherwise(F.col("x_end")).alias("x_end"), "y_start", F.when(high, F.col("y_end") + 20).otherwise(F.col("y_end")).alias("y_end"), text.alias("text"))


_TD = """CASE WHEN col_index = 2 AND row_index % 3 = 1 THEN '    <td></td>' ELSE '    <td' || CASE WHEN col_index = 1 AND row_index > 0 AND (doc_id + row_index) % 4 = 3 THEN ' colspan="2"' WHEN col_index = 0 AND row_index < last THEN ' rowspan="2"' ELSE '' END || '>' || text || CASE WHEN row_index % 2 = 0 THEN '<br>&amp;&quot;&lt;' ELSE '' END || '</td>' END"""
HTML = f"""{D4}, la AS (SELECT doc_id, max(row_index) AS last FROM z GROUP BY 1),
r AS (SELECT doc_id, row_index, string_agg({_TD}, chr(10) ORDER BY col_index) AS tds FROM z JOIN la USING (doc_id) WHERE NOT (col_index = 0 AND row_index % 2 = 1) AND NOT (col_index = 2 AND row_index > 0 AND (doc_id + row_index) % 4 = 3) GROUP BY ALL)"""


@query("html_tables", f"WITH {HTML} SELECT doc_id, '<table>' || chr(10) || string_agg('  <tr>' || chr(10) || tds || chr(10) || '  </tr>', chr(10) ORDER BY row_index) || chr(10) || '</table>' AS html FROM r GROUP BY 1")
def html_tables(s, d):
    return markup.html_tables(_spanned_cells(s, d))


ROWS_CUT = f"""{D4}, v AS (SELECT doc_id // 2 AS island, doc_id % 2 AS part, row_index, col_index, max(row_index) OVER (PARTITION BY doc_id) AS last, text FROM z),
e AS (SELECT island, part, row_index, col_index, CASE WHEN part = 1 AND row_index = 0 AND col_index = 0 THEN '' WHEN island % 3 = 0 AND col_index = 3 AND ((part = 0 AND row_index = last) OR (part = 1 AND row_index = 0)) THEN 'same' WHEN part = 1 AND row_index = 0 THEN text || ' on' ELSE text END AS text, part = 0 AND row_index = last AS tail, part = 1 AND row_index = 0 AS head FROM v),
k AS (SELECT e.*, h.text AS more FROM e LEFT JOIN e h ON e.tail AND h.head AND h.island = e.island AND h.col_index = e.col_index),
w AS (SELECT island, part, row_index, string_agg('<td' || CASE WHEN more IS NOT NULL AND island % 3 = 0 AND col_index = 0 THEN ' rowspan="2"' ELSE '' END || '>' || text || CASE WHEN more <> '' AND island % 3 > 0 THEN '<br/>' || more ELSE '' END || '</td>', '' ORDER BY col_index) AS tds
 FROM k WHERE NOT (head AND EXISTS (SELECT 1 FROM e t WHERE t.tail AND t.island = k.island) AND (island % 3 > 0 OR col_index = 0)) GROUP BY ALL)"""


@query("cross_page_row_merge", f"WITH {ROWS_CUT} SELECT island AS doc_id, island, '<table>' || chr(10) || string_agg('<tr>' || tds || '</tr>', chr(10) ORDER BY part, row_index) || chr(10) || '</table>' AS html FROM w GROUP BY island")
def cross_page_row_merge(s, d):
    """Two orders are the parts of a run; the second's first row goes on with the last row of the first: in one of three
    runs a value stands in both, so only the blank cell before it is joined."""
    c = layout.cells(s, d)
    island, head = F.expr("doc_id div 2"), (F.col("doc_id") % 2 == 1) & (F.col("row_index") == 0)
    tail = (F.col("doc_id") % 2 == 0) & (F.col("row_index") == F.col("last"))
    c = c.withColumn("last", F.max("row_index").over(W.partitionBy("doc_id")))
    text = F.when(head & (F.col("col_index") == 0), "").when((island % 3 == 0) & (F.col("col_index") == 3) & (head | tail), "same").when(head, F.concat("text", F.lit(" on"))).otherwise(F.col("text"))
    parts = markup.html_tables(c.withColumn("text", text)).select(island.alias("island"), (F.col("doc_id") % 2).alias("part_no"), F.regexp_replace("html", r">\s+<", "><").alias("html"))
    return rows.merged_tables(parts.select(F.col("island").alias("doc_id"), "island", "part_no", "html", F.lit(4).alias("col_count")))


CUT = f"""{D4}, ls AS (SELECT doc_id, max(row_index) AS n FROM z GROUP BY 1), ti AS (SELECT doc_id // 2 AS island, list(text ORDER BY col_index) AS t FROM z JOIN ls USING (doc_id) WHERE doc_id % 2 = 0 AND row_index = n GROUP BY ALL),
hi AS (SELECT doc_id // 2 AS island, list(text || ' on' ORDER BY col_index) AS h FROM z WHERE doc_id % 2 = 1 AND row_index = 0 GROUP BY ALL), cu AS (SELECT *, island % 7 AS v FROM ti JOIN hi USING (island))"""
_ONE, _TAIL = "'<td rowspan=\"1\">' || {0} || '</td>'", "'<td>' || array_to_string(t[{0}:], '</td><td>') || '</td>'"


@query(
    "cut_rows",
    f"""WITH {CUT} SELECT island, v > 0 AND v < 6 AS merged, ['another key', 'blank cells', 'blank cells, then a value again', 'single cells', 'blank cells in front', 'goes on below its key', 'a value again'][v + 1] AS rule,
 '<tr>' || CASE v WHEN 1 THEN {_ONE.format('t[1]')} || {_ONE.format("t[2] || '<br/>' || h[2]")} || {_ONE.format("t[3] || '<br/>' || h[3]")} || {_ONE.format("t[4] || '<br/>' || h[4]")}
  WHEN 2 THEN {_ONE.format('t[1]')} || {_TAIL.format(2)} WHEN 3 THEN '<td>' || t[1] || '<br/>' || h[1] || '</td>' WHEN 4 THEN {_ONE.format('t[1]')} || {_TAIL.format(2)}
  WHEN 5 THEN '<td colspan="2">' || t[1] || '</td><td>' || t[2] || h[2] || '</td><td>' || t[3] || '</td><td>' || t[4] || '</td>' ELSE {_TAIL.format(1)} END || '</tr>' AS row,
 CASE v WHEN 2 THEN '<tr><td>' || h[2] || '</td><td>' || h[3] || '</td><td>' || t[4] || '</td></tr>' WHEN 4 THEN '<tr><td>' || h[2] || '</td><td>' || h[3] || '</td></tr>' END AS next_row FROM cu""",
)
def cut_rows(s, d):
    """An order's last row and the next order's first row, changed in one of seven ways."""
    c = layout.cells(s, d).select("doc_id", "row_index", "col_index", "text", F.max("row_index").over(W.partitionBy("doc_id")).alias("last"))
    first = F.col("doc_id") % 2 == 0
    cut = c.filter((first & (F.col("row_index") == F.col("last"))) | (~first & (F.col("row_index") == 0)))
    texts = lambda when, name: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("col_index", "text")))), lambda v: v["text"]).alias(name)
    both = cut.groupBy(F.expr("doc_id div 2").alias("island")).agg(texts(first, "c0"), texts(~first, "c1")).filter("size(c0) > 0 and size(c1) > 0").withColumn("v", F.col("island") % 7)
    t, h = [F.get("c0", k) for k in range(4)], [F.concat(F.get("c1", k), F.lit(" on")) for k in range(4)]
    td = lambda x, attrs="": F.concat(F.lit(f"<td{attrs}>"), x, F.lit("</td>"))
    row = lambda *cells: F.concat(F.lit("<tr>"), *[td(x) for x in cells], F.lit("</tr>"))
    blank, v = F.lit(" "), F.col("v")
    tail = F.when(v == 3, row(t[0])).otherwise(row(*t))
    wide = F.concat(F.lit("<tr>"), td(blank, ' colspan="2"'), td(h[1]), td(blank), td(blank), F.lit("</tr>"))
    head = F.when(v == 0, row(*h)).when(v == 1, row(blank, *h[1:])).when(v == 2, row(blank, h[1], h[2], t[3])).when(v == 3, row(h[0])).when(v == 4, row(blank, h[1], h[2])).when(v == 5, wide).otherwise(row(t[0], *h[1:]))
    pairs = both.select("island", tail.alias("tail"), head.alias("head"), F.lit(None).cast("boolean").alias("key"), F.lit(False).alias("next_row_whole"))
    return row_merge.merged_rows(pairs).select("island", "merged", "rule", "row", "next_row")


def _span_tables(s, d, first, html="html"):
    """A table in markup for each order, its rows in order: what `first` makes of a row stands before its other cells."""
    c = layout.cells(s, d).filter("col_index > 0")
    r = c.groupBy("doc_id", "row_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_index", "text"))), lambda v: F.concat(F.lit("<td>"), v["text"], F.lit("</td>"))), "").alias("tds"))
    r = r.withColumn("last", F.max("row_index").over(W.partitionBy("doc_id")))
    r = r.withColumn("tr", F.concat(F.lit("<tr>"), first, "tds", F.lit("</tr>")))
    return r.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_index", "tr"))), lambda v: v["tr"]), "").alias(html), F.max("row_index").alias("row_no"))


def _even():
    return F.col("row_index") % 2 == 0


SPAN_ROWS = f"{D4}, sq AS (SELECT doc_id, row_index, string_agg('<td>' || text || '</td>', '' ORDER BY col_index) AS tds FROM z WHERE col_index > 0 GROUP BY ALL), sr AS (SELECT *, max(row_index) OVER (PARTITION BY doc_id) AS last FROM sq)"
_TABLE = "'<table>' || chr(10) || string_agg('<tr>' || {0} || tds || '</tr>', chr(10) ORDER BY row_index) || chr(10) || '</table>'"


@query("covered_cells_dropped", f"WITH {SPAN_ROWS} SELECT doc_id, {_TABLE.format(chr(39).join(['CASE WHEN row_index % 2 = 0 THEN ', '<td rowspan=\"2\">k</td>', ' ELSE ', '', ' END']))} AS html FROM sr GROUP BY 1")
def covered_cells_dropped(s, d):
    """Every other row has a cell more, under the span of the row before."""
    t = _span_tables(s, d, F.when(_even(), '<td rowspan="2">k</td>').otherwise("<td>over</td>"))
    return spans.rewritten(t, spans.without_covered)


@query("blank_spans_absorbed", f"WITH {SPAN_ROWS} SELECT doc_id, {_TABLE.format(chr(39).join(['CASE WHEN row_index = 0 THEN ', '<td rowspan=\"', ' || CAST(2 * (last // 2 + 1) AS VARCHAR) || ', '\">k</td>', ' ELSE ', '', ' END']))} AS html FROM sr GROUP BY doc_id")
def blank_spans_absorbed(s, d):
    """Every other row begins with a cell over two rows; those after the first are blank."""
    t = _span_tables(s, d, F.when(F.col("row_index") == 0, '<td rowspan="2">k</td>').when(_even(), '<td rowspan="2"> </td>').otherwise(""))
    return spans.rewritten(t, spans.absorbed)


@query(
    "row_columns",
    f"WITH {D4}, la AS (SELECT doc_id, max(row_index) AS n FROM z GROUP BY 1) SELECT doc_id, CAST(col_index AS INT) AS col, CASE WHEN col_index = 0 THEN 'k' ELSE text END AS text, CASE WHEN col_index = 0 AND n % 2 = 1 THEN CAST(n - 1 AS INT) END AS start_row, CAST(CASE WHEN col_index = 0 AND n % 2 = 1 THEN 2 ELSE 1 END AS INT) AS high FROM z JOIN la USING (doc_id) WHERE row_index = n",
)
def row_columns(s, d):
    """The columns of each table's last row; every other row begins with a cell over two."""
    return spans.row_columns(_span_tables(s, d, F.when(_even(), '<td rowspan="2">k</td>').otherwise("")))


@query("cell_of_lines", f"WITH {D1} SELECT doc_id, page_no AS box_id, string_agg(sep || text, '' ORDER BY y0, line_no) AS text FROM (SELECT *, CASE WHEN lag(y0) OVER w IS NULL THEN '' WHEN y0 - lag(y0) OVER w > 2 THEN '<br>' ELSE ' ' END AS sep FROM l WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y0, line_no)) GROUP BY ALL")
def cell_of_lines(s, d):
    return tables.cell_of_lines(layout.layout_lines(s, d).withColumnRenamed("page_no", "box_id"))


@query("row_groups", f"WITH {D4} SELECT doc_id, row_index, col_index, text FROM z")
def row_groups(s, d):
    c = layout.cells(s, d).select("doc_id", F.col("x_start").alias("x0"), F.col("y_start").alias("y0"), "text")
    return tables.row_groups(c).select("doc_id", "row_index", "col_index", "text")


@query("real_tables", f"WITH {D2}, dr AS (SELECT doc_id, page_no, x0 + k * 30 AS cx, y0 + (table_id % 3) * 20 AS cy FROM t, (SELECT unnest([0, 1, 2, 3]) AS k)) SELECT doc_id, table_id FROM t JOIN dr USING (doc_id, page_no) WHERE cx BETWEEN x0 - 5 AND x1 + 5 AND cy BETWEEN y0 - 5 AND y1 + 5 GROUP BY ALL HAVING count(*) >= 3")
def real_tables(s, d):
    t = layout.layout_tables(s, d)
    strokes = t.select("doc_id", "page_no", F.lit("s").alias("type"), F.explode(F.array(*[F.lit(30.0 * k) for k in range(4)])).alias("k"), "x0", "y0", "table_id")
    cy = F.col("y0") + (F.col("table_id") % 3) * 20
    strokes = strokes.select("doc_id", "page_no", "type", (F.col("x0") + F.col("k") - 8).alias("x0"), cy.alias("y0"), (F.col("x0") + F.col("k") + 8).alias("x1"), cy.alias("y1"))
    return tables.real_tables(t, strokes).select("doc_id", "table_id")


D8 = """o AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page_no, o_orderkey AS k, 1 + o_orderkey % 4 AS r, 1 + o_orderkey % 5 AS c, CAST(100 + o_orderkey % 7 AS DOUBLE) AS y, o_orderkey % 3 = 0 AND o_orderkey % 4 > 0 AND o_orderkey % 5 > 0 AS joint FROM orders),
ro AS (SELECT *, unnest(range(r)) AS i FROM o), li AS (SELECT *, unnest(range(r + 1)) AS i FROM o)"""


@query(
    "rectangles_from_strokes",
    f"WITH {D8} SELECT doc_id, page_no, 40.0::DOUBLE AS x0, y + 30 * i + CASE WHEN i = 0 AND k % 8 = 1 THEN 1 ELSE 0 END AS y0, CAST(40 + 60 * c AS DOUBLE) AS x1, CASE WHEN k % 2 = 0 THEN y + 30 * r ELSE y + 30 * (i + 1) END AS y1 FROM ro WHERE k % 2 = 1 OR i = 0 UNION ALL SELECT doc_id, page_no, 40, 600, 160, 660 FROM o WHERE k % 6 = 0",
)
def rectangles_from_strokes(s, d):
    return lattice.stroke_boxes(layout.drawings(s, d)).drop("box_no")


_BORDERS = f"""{D8}, bl AS (SELECT doc_id, page_no, true AS flat, y + 30 * i + CASE WHEN i % 2 = 1 AND NOT (i = r AND k % 5 = 0) THEN 0.2 ELSE 0 END AS "at", 40.0::DOUBLE AS low, CAST(40 + 60 * c AS DOUBLE) AS high FROM li
 UNION ALL SELECT doc_id, page_no, false, CAST(40 + 60 * j AS DOUBLE), CASE WHEN joint AND j = 1 THEN y + 30 ELSE y END, CASE WHEN k % 6 = 0 AND j <= 2 THEN 660 ELSE y + 30 * r END FROM (SELECT *, unnest(range(c + 1)) AS j FROM o)
 UNION ALL SELECT doc_id, page_no, true, CAST(600 + 30 * i AS DOUBLE), 40, 160 FROM (SELECT *, unnest(range(3)) AS i FROM o WHERE k % 6 = 0)
 UNION ALL SELECT doc_id, page_no, false, 160, 600, 660 FROM o WHERE k % 6 = 0 AND c < 2)"""


@query("border_lines", f"WITH {_BORDERS} SELECT doc_id, page_no, flat, round(\"at\", 1) AS \"at\", low, high FROM bl")
def border_lines(s, d):
    lines = lattice.border_lines(lattice.segments(layout.drawings(s, d)))
    return lines.select("doc_id", "page_no", "flat", F.round("at", 1).alias("at"), "low", "high")


@query(
    "grid_from_borders",
    f"WITH {_BORDERS}, g AS (SELECT doc_id, page_no, flat, CAST(row_number() OVER w - 1 AS INT) AS n, round(\"at\", 1) AS a, lead(round(\"at\", 1)) OVER w AS b FROM bl WINDOW w AS (PARTITION BY doc_id, page_no, flat ORDER BY \"at\")) SELECT y.doc_id, y.page_no, y.n AS row_index, x.n AS col_index, x.a AS x_start, y.a AS y_start, x.b AS x_end, y.b AS y_end FROM g y JOIN g x ON x.doc_id = y.doc_id AND x.page_no = y.page_no AND y.flat AND NOT x.flat WHERE x.b IS NOT NULL AND y.b IS NOT NULL",
)
def grid_from_borders(s, d):
    return lattice.border_grid(lattice.border_lines(lattice.segments(layout.drawings(s, d))))


_LATTICE = f"""{D8}, ys AS (SELECT *, y + 30 * i + CASE WHEN i = 0 AND k % 4 = 1 THEN 1.0 / (2 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) WHEN i % 2 = 1 THEN 0.2 / (1 + CASE WHEN i = r AND k % 5 = 0 THEN 1 ELSE 0 END) ELSE 0 END AS at FROM li),
ce AS (SELECT a.doc_id, a.page_no, 1 AS table_no, CAST(40 + 60 * j AS DOUBLE) AS x0, a.at AS y0, CAST(40 + 60 * (j + CASE WHEN a.joint AND a.i = 0 AND j = 0 THEN 2 ELSE 1 END) AS DOUBLE) AS x1, b.at AS y1
  FROM (SELECT *, unnest(range(c)) AS j FROM ys) a JOIN ys b ON b.doc_id = a.doc_id AND b.page_no = a.page_no AND b.i = a.i + 1 WHERE NOT (a.joint AND a.i = 0 AND j = 1) AND a.r * a.c > 1
 UNION ALL SELECT doc_id, page_no, CASE WHEN r * c > 1 THEN 2 ELSE 1 END, CAST(40 + 60 * j AS DOUBLE), CAST(600 + 30 * i AS DOUBLE), CAST(100 + 60 * j AS DOUBLE), CAST(630 + 30 * i AS DOUBLE) FROM o, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE k % 6 = 0)"""


@query("lattice_cells", f"WITH {_LATTICE} SELECT doc_id, page_no, table_no, x0, round(y0, 3) AS y0, x1, round(y1, 3) AS y1 FROM ce")
def lattice_cells(s, d):
    return lattice.lattice_cells(layout.drawings(s, d)).withColumns({c: F.round(c, 3) for c in ("y0", "y1")})


@query("lattice_tables", f"WITH {_LATTICE} SELECT doc_id, page_no, table_no, min(x0) AS x0, round(min(y0), 3) AS y0, max(x1) AS x1, round(max(y1), 3) AS y1, count(DISTINCT y0) AS row_count, count(DISTINCT x0) AS col_count, count(*) AS n_cells FROM ce GROUP BY ALL")
def lattice_tables(s, d):
    t = lattice.lattice_tables(lattice.lattice_cells(layout.drawings(s, d)))
    return t.withColumns({c: F.round(c, 3) for c in ("y0", "y1")})


@query("text_follows", f"WITH {D1}, tb AS (SELECT DISTINCT doc_id, page_no AS table_id, page_no, 200.0 + page_no % 500 AS y0, 230.0 + page_no % 500 AS y1 FROM l), nx AS (SELECT *, lead(page_no) OVER w AS next_page, lead(y0) OVER w AS next_y0 FROM tb WINDOW w AS (PARTITION BY doc_id ORDER BY table_id)) SELECT doc_id, table_id, (762 - y1 > 10 AND EXISTS (SELECT 1 FROM l WHERE l.doc_id = nx.doc_id AND l.page_no = nx.page_no AND l.y0 < 762 AND l.y1 > nx.y1)) OR coalesce(next_y0 - 80 > 10 AND EXISTS (SELECT 1 FROM l WHERE l.doc_id = nx.doc_id AND l.page_no = next_page AND l.y0 < next_y0 AND l.y1 > 80), false) AS text_between FROM nx")
def text_follows(s, d):
    lines = layout.layout_lines(s, d)
    t = lines.select("doc_id", "page_no").distinct().select("doc_id", F.col("page_no").alias("table_id"), "page_no", (200.0 + F.col("page_no") % 500).alias("y0"), (230.0 + F.col("page_no") % 500).alias("y1"))
    return tables.text_follows(t, lines).select("doc_id", "table_id", "text_between")


TALL = f"""{D1}, tb AS (SELECT DISTINCT doc_id, page_no AS table_id, page_no, 40.0 + 10 * (page_no % 4) AS x0, CASE WHEN page_no % 7 = 0 THEN 300.0 ELSE 85.0 END AS y0, 40.0 + 10 * (page_no % 4) + CASE WHEN page_no % 5 = 0 THEN 440 ELSE 500 END AS x1, CASE WHEN page_no % 3 = 0 THEN 400.0 ELSE 760.0 END AS y1 FROM l),
ta AS (SELECT t.*, lag(page_no) OVER w AS page_b, lag(x0) OVER w AS x0_b, lag(x1) OVER w AS x1_b, lag(y1) OVER w AS y1_b FROM tb t WINDOW w AS (PARTITION BY doc_id ORDER BY table_id))"""


@query(
    "cross_page_pairs_by_text",
    f"""WITH {TALL} SELECT doc_id, table_id FROM ta WHERE page_no - page_b = 1 AND abs(x0 - x0_b) <= 20 AND least(x1 - x0, x1_b - x0_b) / greatest(x1 - x0, x1_b - x0_b) >= 0.9
 AND NOT (762 - y1_b > 10 AND EXISTS (SELECT 1 FROM l WHERE l.doc_id = ta.doc_id AND l.page_no = page_b AND l.y0 < 762 AND l.y1 > y1_b)) AND NOT (ta.y0 - 80 > 10 AND EXISTS (SELECT 1 FROM l WHERE l.doc_id = ta.doc_id AND l.page_no = ta.page_no AND l.y0 < ta.y0 AND l.y1 > 80))""",
)
def cross_page_pairs_by_text(s, d):
    """A table on each page; some leave room for text below or above."""
    lines = layout.layout_lines(s, d)
    page = F.col("page_no")
    x0, wide = 40.0 + 10 * (page % 4), F.when(page % 5 == 0, 440.0).otherwise(500.0)
    t = lines.select("doc_id", "page_no").distinct().select("doc_id", page.alias("table_id"), "page_no", x0.alias("x0"), F.when(page % 7 == 0, 300.0).otherwise(85.0).alias("y0"), (x0 + wide).alias("x1"), F.when(page % 3 == 0, 400.0).otherwise(760.0).alias("y1"))
    return tables.cross_page_pairs(t, lines)


@query("page_structure", f"WITH {D7}, tb AS (SELECT DISTINCT doc_id, page_no FROM i WHERE page_no % 3 > 0) SELECT i.doc_id, i.page_no, has_image, tb.doc_id IS NOT NULL AS has_table, round(length(coalesce(text, '')) / (595.0 * 842.0), 6) AS density, CASE WHEN tb.doc_id IS NOT NULL AND has_image THEN 'mixed' WHEN tb.doc_id IS NOT NULL THEN 'table' WHEN has_image THEN 'image' ELSE 'text' END AS kind FROM i LEFT JOIN tb ON tb.doc_id = i.doc_id AND tb.page_no = i.page_no")
def page_structure(s, d):
    return merge.page_structure(_typed(s, d), layout.page_tables(s, d))


@query("page_lists", f"WITH {D7} SELECT doc_id, bool_or(page_no % 3 > 0) AS has_tables, bool_or(has_image) AS has_images, array_to_string(list(page_no ORDER BY page_no) FILTER (page_no % 3 > 0), ',') AS table_pages, array_to_string(list(page_no ORDER BY page_no) FILTER (has_image), ',') AS image_pages FROM i GROUP BY 1")
def page_lists(s, d):
    text_of = lambda c: F.nullif(F.array_join(F.transform(c, lambda p: p.cast("string")), ","), F.lit("")).alias(c)
    return merge.page_lists(merge.page_structure(_typed(s, d), layout.page_tables(s, d))).select("doc_id", "has_tables", "has_images", text_of("table_pages"), text_of("image_pages"))


@query("tables_by_page", f"WITH {D2S} SELECT doc_id, start_page AS page_no, string_agg(CAST(table_id AS VARCHAR), ',' ORDER BY y0, table_id) AS table_ids FROM s GROUP BY ALL")
def tables_by_page(s, d):
    t = tables.chain_summary(tables.chains(layout.layout_tables(s, d)))
    return assemble.tables_by_page(t).select("doc_id", "page_no", F.array_join(F.transform("table_ids", lambda i: i.cast("string")), ",").alias("table_ids"))


D3 = "im AS (SELECT p_brand AS doc_id, p_partkey AS img_no, CAST(4 + p_size * 25 AS INT) AS width, CAST(10 + (p_partkey % 40) * 25 AS INT) AS height, (p_partkey % 100) / 100.0::DOUBLE AS red_ratio, CAST(1 + p_partkey % 12 AS INT) AS page_no FROM part), np AS (SELECT doc_id, max(page_no) AS pages FROM im GROUP BY 1)"
KEPT = f"{D3}, ki AS (SELECT im.* FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, width, height) AS n FROM im) im JOIN np USING (doc_id) WHERE least(width, height) >= 14 AND n <= floor(pages * 0.8))"


def _kept(s, d):
    i = layout.images(s, d)
    return img.size_filter(i, i.groupBy("doc_id").agg(F.max("page_no").alias("pages")))


@query("image_size_filter", f"WITH {KEPT} SELECT doc_id, img_no FROM ki")
def image_size_filter(s, d):
    return _kept(s, d).select("doc_id", "img_no")


@query("image_stats", f"WITH {D3} SELECT doc_id, count(*) AS total, count(DISTINCT page_no) AS pages_with_images, round(avg(width), 4) AS avg_width, round(avg(height), 4) AS avg_height, count(DISTINCT (width, height)) AS unique_sizes FROM im GROUP BY 1")
def image_stats(s, d):
    return img.statistics(layout.images(s, d))


@query("empty_pages_to_render", f"WITH {KEPT}, pp AS (SELECT doc_id, page_no, CASE WHEN page_no % 4 = 0 THEN 'x' ELSE ' ' END AS text FROM np, (SELECT unnest(range(1, 16)) AS page_no)) SELECT doc_id, CAST(page_no AS INT) AS page_no FROM pp WHERE trim(text) = '' AND NOT EXISTS (SELECT 1 FROM ki WHERE ki.doc_id = pp.doc_id AND ki.page_no = pp.page_no)")
def empty_pages_to_render(s, d):
    pages = layout.images(s, d).select("doc_id").distinct().withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(15)))).withColumn("text", F.when(F.col("page_no") % 4 == 0, "x").otherwise(" "))
    return img.pages_to_render(pages, _kept(s, d))


@query("stamp_candidates", f"WITH {D3} SELECT doc_id, img_no FROM im WHERE least(width, height) >= 30 AND greatest(width, height) <= 1000 AND width / height BETWEEN 0.7 AND 1.5 AND red_ratio >= 0.8")
def stamp_candidates(s, d):
    return img.stamp_candidates(layout.images(s, d)).select("doc_id", "img_no")


@query("non_stamps", f"WITH {D3} SELECT doc_id, img_no FROM im WHERE NOT (least(width, height) >= 30 AND greatest(width, height) <= 1000 AND width / height BETWEEN 0.7 AND 1.5 AND red_ratio >= 0.8)")
def non_stamps(s, d):
    return img.non_stamps(layout.images(s, d)).select("doc_id", "img_no")


@query("size_histogram", f"WITH {D3} SELECT doc_id, width, height, count(*) AS n FROM im GROUP BY ALL")
def size_histogram(s, d):
    return img.size_histogram(layout.images(s, d))


@query("red_ratio", f"WITH {D3}, px AS (SELECT doc_id, img_no, (img_no * 7 + k * 31) % 256 AS r, (img_no * 3 + k * 17) % 256 AS g, (img_no + k * 13) % 256 AS b FROM im, (SELECT unnest(range(16)) AS k)), v AS (SELECT doc_id, img_no, NOT (r > 240 AND g > 240 AND b > 240) AND NOT (r < 60 AND g < 60 AND b < 60) AS ok, (r > g AND r > b AND r >= 100) OR (r > g + 20 AND r > b + 20 AND r >= 80) OR (r >= 150 AND g < 200 AND b < 200 AND r > g AND r > b) OR (r >= 180 AND r - g > 10 AND r - b > 10) AS red FROM px) SELECT doc_id, img_no, CASE WHEN count(*) FILTER (ok) = 0 THEN 0.0 ELSE round(count(*) FILTER (ok AND red) / count(*) FILTER (ok), 6) END::DOUBLE AS red_ratio FROM v GROUP BY ALL")
def red_ratio(s, d):
    at = lambda i, k: ((F.col("img_no") * i + F.col("k") * k) % 256)
    px = layout.images(s, d).select("doc_id", "img_no", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return img.red_ratio(px.select("doc_id", "img_no", at(7, 31).alias("r"), at(3, 17).alias("g"), at(1, 13).alias("b"))).withColumn("red_ratio", F.round("red_ratio", 6))


@query("images_with_rendered", f"WITH {KEPT}, pp AS (SELECT doc_id, page_no, CASE WHEN page_no % 4 = 0 THEN 'x' ELSE ' ' END AS text FROM np, (SELECT unnest(range(1, 16)) AS page_no)) SELECT doc_id, CAST(page_no AS INT) AS page_no, CAST(img_no AS BIGINT) AS img_no, false AS is_rendered FROM ki UNION ALL SELECT doc_id, CAST(page_no AS INT), 0, true FROM pp WHERE trim(text) = '' AND NOT EXISTS (SELECT 1 FROM ki WHERE ki.doc_id = pp.doc_id AND ki.page_no = pp.page_no)")
def images_with_rendered(s, d):
    pages = layout.images(s, d).select("doc_id").distinct().withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(15)))).withColumn("text", F.when(F.col("page_no") % 4 == 0, "x").otherwise(" "))
    return img.with_rendered(_kept(s, d), pages)


def _vectors(s, d):
    return layout.table(s, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("v"))


PAIRS = """v AS (SELECT label AS doc_id, vec_id AS ord, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
pr AS (SELECT a.doc_id, a.ord AS a, b.ord AS b, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS sim FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.ord < b.ord),
ps AS (SELECT * FROM pr WHERE sim >= 0.35)"""
GROUPS = f"{PAIRS}, ed AS (SELECT doc_id, a AS x, b AS y FROM ps UNION ALL SELECT doc_id, b, a FROM ps), re AS (SELECT doc_id, ord, ord AS r FROM v UNION SELECT re.doc_id, ed.y, re.r FROM re JOIN ed ON re.doc_id = ed.doc_id AND re.ord = ed.x AND re.r < ed.y), gr AS (SELECT doc_id, ord, min(r) AS grp FROM re GROUP BY ALL)"


@query("stamp_similarity_pairs", f"WITH {PAIRS} SELECT doc_id, a, b, round(sim, 4) AS similarity FROM ps")
def stamp_similarity_pairs(s, d):
    return img.similar_pairs(_vectors(s, d), 0.35)


@query("stamp_groups", f"WITH RECURSIVE {GROUPS} SELECT * FROM gr")
def stamp_groups(s, d):
    return img.stamp_groups(_vectors(s, d), img.similar_links(_vectors(s, d), 0.35))


@query("stamp_representatives", f"WITH RECURSIVE {GROUPS} SELECT doc_id, grp AS representative, count(*) - 1 AS duplicates FROM gr GROUP BY ALL")
def stamp_representatives(s, d):
    return img.representatives(stamp_groups(s, d))


@query("stamp_statistics", f"WITH RECURSIVE {GROUPS} SELECT doc_id, count(*) AS candidates, count(DISTINCT grp) AS unique, count(*) - count(DISTINCT grp) AS duplicated, CAST(0 AS BIGINT) AS non_stamps FROM gr GROUP BY 1")
def stamp_statistics(s, d):
    return img.stamp_statistics(_vectors(s, d), stamp_groups(s, d))


@query("escape_html_text", "SELECT page_id, md5(array_to_string(list_transform(string_split(coalesce(html, ''), '<br>'), lambda h: replace(replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')), '<br>')) AS escaped_md5 FROM pages")
def escape_html_text(s, d):
    return layout.table(s, d, "pages").select("page_id", F.md5(txt.escape_html(F.col("html"))).alias("escaped_md5"))


TB = """tb AS (SELECT doc_id, page_no, k AS table_id, 40.0 AS x0, k * 200 - 60.0 AS y0, 555.0 AS x1, k * 200 + 40.0 AS y1 FROM p, (SELECT unnest([1, 2]) AS k) WHERE k <= page_no % 3),
o AS (SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.doc_id = l.doc_id AND tb.page_no = l.page_no AND l.x0 >= tb.x0 - 5 AND l.x1 <= tb.x1 + 5 AND l.y0 >= tb.y0 - 5 AND l.y1 <= tb.y1 + 5))"""


@query("text_excluding_tables", f"WITH {D1}, {TB}, tp AS (SELECT doc_id, page_no, min(y0) AS top FROM tb GROUP BY ALL), pl AS (SELECT DISTINCT doc_id, page_no FROM l) SELECT pl.doc_id, pl.page_no, coalesce(string_agg(o.text, chr(10) ORDER BY o.y0, o.line_no) FILTER (o.text IS NOT NULL AND (top IS NULL OR o.y0 < top)), '') AS before, coalesce(string_agg(o.text, chr(10) ORDER BY o.y0, o.line_no) FILTER (o.y0 >= top), '') AS after FROM pl LEFT JOIN o ON o.doc_id = pl.doc_id AND o.page_no = pl.page_no LEFT JOIN tp ON tp.doc_id = pl.doc_id AND tp.page_no = pl.page_no GROUP BY ALL")
def text_excluding_tables(s, d):
    return text.text_excluding_tables(layout.layout_lines(s, d), layout.page_tables(s, d))


@query("text_between_tables", f"WITH {D1}, {TB}, g AS (SELECT doc_id, page_no, table_id, lag(y1) OVER (PARTITION BY doc_id, page_no ORDER BY y0, table_id) AS gap0, y0 AS gap1 FROM tb) SELECT g.doc_id, g.page_no, g.table_id, string_agg(o.text, chr(10) ORDER BY o.y0, o.line_no) AS text FROM g JOIN o ON o.doc_id = g.doc_id AND o.page_no = g.page_no AND o.y0 > gap0 AND o.y0 < gap1 GROUP BY ALL")
def text_between_tables(s, d):
    return text.text_between_tables(layout.layout_lines(s, d), layout.page_tables(s, d))


CLEAN = f"array_to_string(list_filter({{0}}, lambda v: NOT {NUM.format('v')} AND NOT list_contains(known, v)), chr(10))"
ASSEMBLED = f"""{D1}, tb AS (SELECT doc_id, page_no, k, page_no * 10 + k AS id, k * 200 - 60.0 AS y0, k * 200 + 40.0 AS y1, page_no + CASE WHEN k = 1 AND page_no % 12 = 4 THEN 1 WHEN k = 1 AND page_no % 12 = 7 THEN 2 ELSE 0 END AS upto FROM p, (SELECT unnest([1, 2]) AS k) WHERE k <= page_no % 3),
cv AS (SELECT doc_id, id, unnest(range(page_no + 1, upto + 1)) AS page_no FROM tb), co AS (SELECT doc_id, page_no, max(id) AS cover FROM cv GROUP BY ALL),
sl AS (SELECT doc_id, page_no, y0, 0 AS part, id, y1, k, upto FROM tb UNION ALL SELECT doc_id, page_no, 600.0, 1, cover, 700.0, 0, 0 FROM co),
so AS (SELECT *, row_number() OVER w AS n, lag(y1) OVER w AS prev, count(*) OVER (PARTITION BY doc_id, page_no) AS slots, min(y0) OVER (PARTITION BY doc_id, page_no) AS top, max(part) OVER (PARTITION BY doc_id, page_no) = 1 AS covered, min(part) OVER (PARTITION BY doc_id, page_no) = 0 AS tabled FROM sl WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y0, part, id)),
pg AS (SELECT DISTINCT doc_id, page_no, slots, top, covered, tabled FROM so),
o AS (SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.doc_id = l.doc_id AND sl.page_no = l.page_no AND l.x0 >= 35 AND l.x1 <= 560 AND l.y0 >= sl.y0 - 5 AND l.y1 <= sl.y1 + 5)),
kn AS (SELECT doc_id, list(DISTINCT text) AS known FROM c GROUP BY 1), nw AS (SELECT DISTINCT doc_id, [] AS none FROM p),
f AS (SELECT p.doc_id, p.page_no, p.ls, coalesce(slots, 0) AS slots, top, coalesce(covered, false) AS covered, coalesce(tabled, false) AS tabled, p.page_no % 4 = 0 AS pictured, coalesce(known, []) AS known, EXISTS (SELECT 1 FROM o WHERE o.doc_id = p.doc_id AND o.page_no = p.page_no) AS told FROM p LEFT JOIN pg ON pg.doc_id = p.doc_id AND pg.page_no = p.page_no LEFT JOIN kn ON kn.doc_id = p.doc_id),
tx AS (SELECT o.doc_id, o.page_no, CASE WHEN y0 < top THEN 0 ELSE 1 END AS n, list(text ORDER BY y0, line_no) AS ls FROM o JOIN f USING (doc_id, page_no) WHERE slots > 0 AND NOT (pictured AND NOT tabled) AND (slots = 1 OR y0 < top) GROUP BY ALL
 UNION ALL SELECT o.doc_id, o.page_no, so.n - 1, list(o.text ORDER BY o.y0, line_no) FROM o JOIN so ON so.doc_id = o.doc_id AND so.page_no = o.page_no AND so.n > 1 AND o.y0 > prev AND o.y0 < so.y0 WHERE so.tabled GROUP BY ALL
 UNION ALL SELECT o.doc_id, o.page_no, slots, list(o.text ORDER BY o.y0, line_no) FROM o JOIN so ON so.doc_id = o.doc_id AND so.page_no = o.page_no AND so.n = slots AND slots > 1 AND o.y0 > so.y1 WHERE so.tabled GROUP BY ALL),
it AS (SELECT doc_id, page_no, -1 AS seq, 0.0 AS y, 0 AS ord, '第 ' || page_no || ' 页' AS text FROM f
 UNION ALL SELECT doc_id, page_no, 0, 0.0, 0, trim({CLEAN.format('ls')}, chr(10) || ' ') FROM f WHERE slots = 0 AND NOT (pictured AND told)
 UNION ALL SELECT tx.doc_id, tx.page_no, 2 * tx.n, 0.0, 0, trim({CLEAN.format('tx.ls')}, chr(10) || ' ') FROM tx JOIN f USING (doc_id, page_no)
 UNION ALL SELECT o.doc_id, o.page_no, 0, o.y0, o.line_no, trim({CLEAN.format('[o.text]')}, chr(10) || ' ') FROM o JOIN f USING (doc_id, page_no) WHERE pictured AND NOT tabled
 UNION ALL SELECT doc_id, page_no, 2 * n - 1, 0.0, 0, '表格（第' || page_no || CASE WHEN upto > page_no THEN '-' || upto ELSE '' END || '页）' || chr(10) || chr(10) || CASE WHEN k = 1 THEN '<table></table>' ELSE '(未能识别)' END FROM so WHERE part = 0
 UNION ALL SELECT doc_id, page_no, CASE WHEN told AND NOT tabled THEN 0 ELSE 1000 END, 300.0, 1000000, 'seen on ' || page_no FROM f WHERE pictured),
ok AS (SELECT * FROM it WHERE text <> ''), gone AS (SELECT doc_id, page_no FROM f WHERE covered AND NOT pictured AND NOT EXISTS (SELECT 1 FROM tx JOIN f g USING (doc_id, page_no) WHERE tx.doc_id = f.doc_id AND tx.page_no = f.page_no AND {CLEAN.format('tx.ls')} <> '')),
ps AS (SELECT doc_id, page_no, string_agg(text || chr(10) || chr(10), '' ORDER BY seq, y, ord) AS text FROM ok ANTI JOIN gone ON gone.doc_id = ok.doc_id AND gone.page_no = ok.page_no GROUP BY ALL)"""


@query("assemble_document", f"WITH {ASSEMBLED} SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS text FROM ps GROUP BY 1")
def assemble_document(s, d):
    """Tables of some pages go on to the next one or two."""
    pages, lines, boxes = layout.page_rows(s, d), layout.layout_lines(s, d), layout.page_tables(s, d)
    on = F.when((F.col("table_id") == 1) & (F.col("page_no") % 12 == 4), 1).when((F.col("table_id") == 1) & (F.col("page_no") % 12 == 7), 2).otherwise(0)
    shown = boxes.select("doc_id", (F.col("page_no") * 10 + F.col("table_id")).alias("table_id"), F.col("page_no").alias("start_page"), (F.col("page_no") + on).alias("end_page"), "x0", "y0", "x1", "y1", F.when(F.col("table_id") == 1, "<table></table>").alias("html"))
    parts = shown.filter("start_page < end_page").select("doc_id", "table_id", F.explode(F.sequence(F.col("start_page") + 1, F.col("end_page"))).alias("page_no"), F.lit(40.0).alias("x0"), F.lit(600.0).alias("y0"), F.lit(555.0).alias("x1"), F.lit(700.0).alias("y1"))
    seen = pages.filter("page_no % 4 = 0").select("doc_id", "page_no", F.lit(1).alias("img_no"), F.lit(300.0).alias("y0"), F.concat(F.lit("seen on "), F.col("page_no").cast("string")).alias("text"))
    return assemble.assembled(pages, lines, shown, parts, seen, text.common_texts(lines))


@query(
    "image_result_files",
    f"""WITH {D5}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, img_no, name, text) AS file_no FROM im WHERE trim(text, chr(10) || chr(13) || chr(9) || ' ') <> '')
SELECT doc_id, file_no, 'image_' || file_no || '_page_' || page_no || '_' || replace(name, '.png', '') || '.txt' AS name,
 '图片序号: ' || file_no || chr(10) || '页码: 第' || page_no || '页' || chr(10) || '原始图片: ' || name || chr(10) || repeat('=', 80) || chr(10) || chr(10) || text AS text FROM n""",
)
def image_result_files(s, d):
    return files.image_results(layout.ocr_pages(s, d)[1])


BOOKS = """bo AS (SELECT p_brand || '.xlsx' AS path, p_size, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS INT) AS sheet_no, CAST(row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS INT) AS n, p_partkey, p_name, p_type FROM part)"""


@query(
    "workbook_rows",
    f"WITH {BOOKS} SELECT path, sheet_no, 'size ' || p_size AS sheet_name, CAST(n + 1 AS INT) AS row_no, p_partkey || '|' || p_name || '|' || p_type AS cells FROM bo UNION ALL SELECT DISTINCT path, sheet_no, 'size ' || p_size, 1, 'key|name|type' FROM bo UNION ALL SELECT path, CAST(max(sheet_no) + 1 AS INT), 'none', 1, 'key' FROM bo GROUP BY 1",
)
def workbook_rows(s, d):
    return xlsx.read_sheets(layout.workbooks(s, d)).filter("row_no > 0").select("path", "sheet_no", "sheet_name", "row_no", F.array_join("cells", "|").alias("cells"))


@query(
    "workbook_sheet_rows",
    f"WITH {BOOKS} SELECT path, CAST(n + 1 AS INT) AS row_no, p_name AS name FROM bo WHERE p_size = 7",
)
def workbook_sheet_rows(s, d):
    """One sheet of each workbook; the others are not parsed."""
    return xlsx.read_sheets(layout.workbooks(s, d), ["size 7"]).filter("row_no > 1").select("path", "row_no", F.get("cells", F.lit(1)).alias("name"))


@query(
    "workbook_info",
    f"WITH {BOOKS} SELECT path, sheet_no, 'size ' || p_size AS sheet_name, CAST(count(*) AS INT) AS n_rows, 3 AS n_columns, 'key,name,type' AS column_names, false AS is_empty FROM bo GROUP BY ALL UNION ALL SELECT path, CAST(max(sheet_no) + 1 AS INT), 'none', 0, 1, 'key', true FROM bo GROUP BY 1",
)
def workbook_info(s, d):
    info = xlsx.sheet_info(xlsx.read_sheets(layout.workbooks(s, d)))
    return info.withColumn("column_names", F.array_join("column_names", ","))


@query(
    "workbook_text",
    f"""WITH {BOOKS}, wi AS (SELECT path, sheet_no, p_size, CAST(greatest(3, max(length(CAST(p_partkey AS VARCHAR))) + 1) AS INT) AS a, CAST(greatest(4, max(length(p_name)) + 1) AS INT) AS b, CAST(greatest(4, max(length(p_type)) + 1) AS INT) AS c, CAST(length(CAST(count(*) - 1 AS VARCHAR)) AS INT) AS i FROM bo GROUP BY ALL),
sh AS (SELECT bo.path, bo.sheet_no, '=== 工作表: size ' || bo.p_size || ' ===' || chr(10) || repeat(' ', i) || ' ' || lpad('key', a, ' ') || ' ' || lpad('name', b, ' ') || ' ' || lpad('type', c, ' ') || chr(10)
 || string_agg(rpad(CAST(n - 1 AS VARCHAR), i, ' ') || ' ' || lpad(CAST(p_partkey AS VARCHAR), a, ' ') || ' ' || lpad(p_name, b, ' ') || ' ' || lpad(p_type, c, ' '), chr(10) ORDER BY n) || chr(10) AS text FROM bo JOIN wi ON wi.path = bo.path AND wi.sheet_no = bo.sheet_no GROUP BY bo.path, bo.sheet_no, bo.p_size, i, a, b, c)
SELECT path, string_agg(text, chr(10) ORDER BY sheet_no) || chr(10) || '=== 工作表: none ===' || chr(10) || '(空工作表)' || chr(10) AS text FROM sh GROUP BY 1""",
)
def workbook_text(s, d):
    return xlsx.workbook_text(xlsx.read_sheets(layout.workbooks(s, d)))


def _report_tables(s, d):
    """The runs of tables of each document, with the ids of their parts; one of three has no markup."""
    chained = tables.chains(layout.layout_tables(s, d))
    ids = chained.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list("table_id")).alias("merged_from"))
    runs = tables.chain_summary(chained).join(ids, ["doc_id", "island"])
    html = F.when(F.col("table_id") % 3 > 0, F.concat(F.lit("<t"), F.col("table_id").cast("string"), F.lit(">"))).otherwise("")
    return runs.withColumn("html", html).withColumn("image", F.when(F.col("table_id") % 2 == 0, F.concat(F.lit("t"), F.col("table_id").cast("string"), F.lit(".png"))))


_W, _T = "repeat('=', 100) || chr(10)", "repeat('-', 100) || chr(10)"


@query(
    "table_report",
    f"""WITH {D2S}, me AS (SELECT doc_id, island, '[' || string_agg(CAST(table_id AS VARCHAR), ', ' ORDER BY table_id) || ']' AS ids FROM k GROUP BY ALL)
SELECT doc_id, {_W} || 'PDF表格识别结果' || chr(10) || {_W} || chr(10) || string_agg('【表格 ' || table_id || '】' || chr(10) || '页码: ' || start_page || CASE WHEN page_count > 1 THEN '-' || end_page ELSE '' END || chr(10)
 || CASE WHEN page_count > 1 THEN '类型: 跨页表格 (跨' || page_count || '页)' || chr(10) || '合并自: 表格' || ids ELSE '类型: 单页表格' END || chr(10) || '列数: ' || col_count || chr(10) || '行数: ' || row_count || chr(10)
 || '图片: ' || CASE WHEN table_id % 2 = 0 THEN 't' || table_id || '.png' ELSE '无' END || chr(10) || chr(10) || '识别内容:' || chr(10) || {_T} || CASE WHEN table_id % 3 > 0 THEN '<t' || table_id || '>' ELSE '(识别失败)' END || chr(10) || {_T} || chr(10), '' ORDER BY table_id) AS text FROM s JOIN me USING (doc_id, island) GROUP BY 1""",
)
def table_report(s, d):
    return files.table_reports(_report_tables(s, d))


_RULE = "repeat('=', 80) || chr(10) || chr(10)"


@query(
    "table_result_files",
    f"""WITH {D2S}, pt AS (SELECT k.doc_id, s.table_id, k.page_no, row_number() OVER (PARTITION BY k.doc_id, k.island ORDER BY k.table_id) AS part, page_count, s.col_count, s.row_count FROM k JOIN s USING (doc_id, island))
SELECT doc_id, 'table_' || table_id || '_part' || part || '_page_' || page_no || '.txt' AS name, '跨页表格ID: ' || table_id || ' (第' || part || '/' || page_count || '部分)' || chr(10) || '页码: 第' || page_no || '页' || chr(10) || '原始图片: p' || part || '.png' || chr(10) || {_RULE} || '<p' || part || '>' AS text FROM pt WHERE page_count > 1
UNION ALL SELECT doc_id, 'table_' || table_id || '_page_' || page_no || '.txt', '表格ID: ' || table_id || chr(10) || '页码: 第' || page_no || '页' || chr(10) || '类型: 单页表格' || chr(10) || '列数: ' || col_count || chr(10) || '行数: ' || row_count || chr(10) || {_RULE} || '<t' || table_id || '>' FROM pt WHERE page_count = 1 AND table_id % 3 > 0""",
)
def table_result_files(s, d):
    """A file for each table of one page and for each part of a table over pages."""
    runs = _report_tables(s, d)
    parts = runs.filter("page_count > 1").select("doc_id", "island", "table_id", F.posexplode("merged_from").alias("k", "part")).withColumn("part_no", F.col("k") + 1)
    where = layout.layout_tables(s, d).select("doc_id", F.col("table_id").alias("part"), "page_no")
    no = F.col("part_no").cast("string")
    parts = parts.join(where, ["doc_id", "part"]).withColumn("image", F.concat(F.lit("p"), no, F.lit(".png"))).withColumn("html", F.concat(F.lit("<p"), no, F.lit(">")))
    alone = runs.filter("page_count = 1").withColumn("page_no", F.col("start_page"))
    return files.part_results(parts).unionByName(files.table_results(alone))


@query("sheet_csv", f"""WITH {BOOKS} SELECT path, 'size ' || p_size AS sheet_name, chr(65279) || 'key,name,type' || chr(10) || string_agg(p_partkey || ',"' || p_name || '"",""x",' || p_type || chr(10), '' ORDER BY n) AS text FROM bo WHERE p_size > 0 GROUP BY path, p_size UNION ALL SELECT DISTINCT path, 'none', chr(65279) || 'key' || chr(10) FROM bo""")
def sheet_csv(s, d):
    """Names get a quote and a comma, to be quoted."""
    rows = xlsx.read_sheets(layout.workbooks(s, d))
    odd = F.transform("cells", lambda v, k: F.when((F.col("row_no") > 1) & (k == 1), F.concat(v, F.lit('","x'))).otherwise(v))
    return files.sheet_csv(rows.withColumn("cells", odd))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("first_pages", "SELECT l_orderkey, CAST(l_linenumber AS INT) AS line, CAST(l_suppkey AS INT) AS page_no FROM lineitem")
def first_pages(s, d):
    to = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("-"), F.col("l_suppkey") + F.col("l_linenumber"))).otherwise("")
    return layout.table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("line"), txt.first_page(F.concat("l_suppkey", to)).alias("page_no"))


@query("key_cells", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS has_key FROM orders")
def key_cells(s, d):
    cell = F.when(F.col("o_orderkey") % 3 == 0, " \n").otherwise(F.col("o_orderpriority"))
    return layout.table(s, d, "orders").select("o_orderkey", txt.has_key_cell(F.concat(F.lit("<tr><td rowspan='2'>"), cell, F.lit("</td><td>"), "o_orderstatus", F.lit("</td></tr>"))).alias("has_key"))


def stamp_vectors(s, d):
    """Vectors of pixels, told by their number of places, sum and greatest place; resampling is no SQL (tests/test_stamps.py)."""
    v = stamps.stamp_vectors(layout.stamp_pixels(s, d))
    return v.select("doc_id", "img_no", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.round(F.array_max("v"), 4).alias("top"))


_QUERIES["stamp_vectors"] = stamp_vectors
