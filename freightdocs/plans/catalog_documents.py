"""Queries of triage, grids and pages (DOC), rendering (OUT) and evaluation (EVL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.functions.plan import spread
from freightdocs.operators import evaluate, grids, pages, render, triage
from freightdocs.operators import issues as iss
from freightdocs.plans.catalog import blank_record, item, items, keyed, register, with_facts
from freightdocs.schemas import SOURCE_TYPE
from freightdocs.session import read_table

# ------------------------------------------------------------------ triage
MAGIC = (
    (b"", "html"), (b"0123456789%PDF-1.7", "pdf"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"BM", "bmp"),
    (b"RIFF....WEBP", "webp"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole"), (b" \n{\\rtf1", "rtf"),
    (b"<?xml version='1.0'?> schemas.microsoft.com/office/word/2003/wordml", "word_xml"), (b"PK\x03\x04 word/document.xml", "docx"),
    (b"PK\x03\x04 xl/workbook.xml", "xlsx"), (b"PK\x03\x04", "zip"), (b"plain", "unknown"), (None, "empty"), (b"GIF89a", "gif"), (b"II*\x00", "tiff"),
)
DETECTED_SQL = "CASE page_id % 16 " + " ".join(f"WHEN {i} THEN '{name}'" for i, (_, name) in enumerate(MAGIC)) + " END"
SUFFIXES = (".pdf", ".docx", ".png", ".xls", ".txt", ".doc", ".jpg")
SUFFIX_SQL = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END"


def page_files(spark, sf):
    """Raw pages as files of many kinds: a mark before the content, a suffix by key."""
    def content(mark):
        return F.lit(bytearray()) if mark is None else F.concat(F.lit(bytearray(mark)), F.encode("html", "UTF-8"))
    c = None
    for i, (mark, _) in enumerate(MAGIC):
        hit = F.col("page_id") % 16 == i
        c = F.when(hit, content(mark)) if c is None else c.when(hit, content(mark))
    return read_table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.concat(F.lit("p"), F.expr(SUFFIX_SQL)).alias("file"), c.alias("content"), F.col("html").alias("text"))


@register("doc_1_formats", f"SELECT page_id AS doc_id, {DETECTED_SQL} AS detected FROM pages")
def _(spark, sf):
    return page_files(spark, sf).select("doc_id", triage.detect_format(F.col("content")).alias("detected"))


@register("doc_2_suffix_check", f"""
WITH p AS (SELECT page_id, {DETECTED_SQL} AS d, {SUFFIX_SQL} AS s FROM pages)
SELECT page_id AS doc_id, CASE WHEN s IN ('.png', '.jpg') AND d NOT IN ('jpeg', 'png', 'bmp', 'webp', 'gif', 'tiff') THEN 'unsupported_image_content'
  WHEN s = '.png' AND d <> 'png' OR s = '.jpg' AND d <> 'jpeg' THEN 'file_format_mismatch' WHEN s NOT IN ('.png', '.jpg') AND d = 'empty' THEN 'empty_file'
  WHEN s = '.pdf' AND d <> 'pdf' OR s = '.docx' AND d <> 'docx' OR s = '.xls' AND d NOT IN ('ole', 'xlsx', 'unknown')
    OR s = '.doc' AND d NOT IN ('ole', 'word_xml', 'rtf', 'html', 'unknown') THEN 'file_format_mismatch' END AS content_error FROM p""")
def _(spark, sf):
    df = page_files(spark, sf).select("doc_id", triage.suffix_of(F.col("file")).alias("suffix"), triage.detect_format(F.col("content")).alias("detected"))
    return triage.validate_content(df, D.suffix_format_table(spark)).select("doc_id", "content_error")


@register("doc_3_upload_limits", """
SELECT doc_id, CASE WHEN strlen(text) > 3000 THEN 'file_too_large' WHEN doc_id % 7 = 0 THEN 'empty_file' END AS upload_error FROM documents""")
def _(spark, sf):
    df = read_table(spark, sf, "documents")
    n = F.when((F.col("doc_id") % 7 == 0) & (F.octet_length("text") <= 3000), 0).otherwise(F.octet_length("text"))
    return df.select("doc_id", triage.upload_error(n, cap=3000).alias("upload_error"))


@register("doc_4_provenance", """
SELECT doc_id, sha256(text) AS source_sha256, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE sha256(text) END AS content_sha256, strlen(text) AS source_bytes,
  CASE WHEN doc_id % 5 = 0 THEN 0 ELSE length(text) END AS content_chars FROM documents""")
def _(spark, sf):
    df = read_table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"),
                                                   F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"))
    return triage.provenance(df).select("doc_id", "source_sha256", "content_sha256", "source_bytes", "content_chars")


# ------------------------------------------------------------------ grids
FORMATS = ("yyyy-mm-dd", "yyyy/mm/dd hh:mm", "dd hh:mm:ss", "h:mm", "General", "Height", "[h]:mm:ss")


@register("doc_5_cell_rendering", """
SELECT event_id, CASE event_id % 8 WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%H:%M')
  WHEN 6 THEN strftime(ts, '%H:%M:%S') WHEN 7 THEN event_type || '<br>x|y <br>' ELSE strftime(ts, '%Y-%m-%d') END AS cell,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) || '.5' END AS legacy FROM events""")
def _(spark, sf):
    ev = read_table(spark, sf, "events")
    fmt = F.get(F.array(*[F.lit(x) for x in FORMATS]), (F.col("event_id") % 8).cast("int"))
    stamp = F.when(F.col("event_id") % 8 != 7, F.col("ts"))
    number = F.col("event_id").cast("double") + F.when(F.col("event_id") % 2 == 1, 0.5).otherwise(0.0)
    null = F.lit(None)
    return ev.select("event_id", grids.rendered(F.concat("event_type", F.lit("\r\nx|y \n")), stamp, fmt).alias("cell"),
                     grids.legacy_rendered(number, null.cast("timestamp"), null.cast("string")).alias("legacy"))


CELLS_SQL = """
cells AS (SELECT o_orderkey // 100 AS doc_id, 's' AS sheet, (o_orderkey % 100) // 10 + 1 AS row, o_orderkey % 10 + 1 AS col,
  CASE WHEN (o_orderkey % 100) // 10 >= 7 OR o_orderkey % 10 >= 8 OR o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority || '|' END AS value, o_orderkey AS k FROM orders)"""


def cells(spark, sf):
    """Sheets of ten by ten cells made from orders; outer and some inner cells are blank."""
    return read_table(spark, sf, "orders").select(*[F.expr(e) for e in (
        "o_orderkey div 100 AS doc_id", "'s' AS sheet", "(o_orderkey % 100) div 10 + 1 AS row", "o_orderkey % 10 + 1 AS col",
        "CASE WHEN (o_orderkey % 100) div 10 >= 7 OR o_orderkey % 10 >= 8 OR o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority || '|' END AS value",
        "o_orderkey AS k", "CASE WHEN o_orderkey % 9 = 0 THEN '=A1' END AS formula")])


def ranges(spark, sf):
    return read_table(spark, sf, "orders").filter("o_orderkey % 100 = 0").select(*[F.expr(e) for e in (
        "o_orderkey div 100 AS doc_id", "'s' AS sheet", "2 AS r1", "4 AS r2", "2 AS c1", "3 AS c2")])


@register("doc_6_merged_ranges", f"""
WITH {CELLS_SQL} SELECT doc_id, row, col FROM cells WHERE NOT (row BETWEEN 2 AND 4 AND col BETWEEN 2 AND 3 AND NOT (row = 2 AND col = 2))""")
def _(spark, sf):
    return grids.suppress_merged(cells(spark, sf), ranges(spark, sf)).select("doc_id", "row", "col")


BOUNDS_SQL = CELLS_SQL + ", bounds AS (SELECT doc_id, max(row) AS max_row, max(col) AS max_col FROM cells WHERE value <> '' OR k % 9 = 0 GROUP BY 1)"


@register("doc_7_outer_trim", f"""
WITH {BOUNDS_SQL} SELECT c.doc_id, row, col, value FROM cells c JOIN bounds b ON b.doc_id = c.doc_id WHERE row <= max_row AND col <= max_col""")
def _(spark, sf):
    return grids.trim(cells(spark, sf)).select("doc_id", "row", "col", "value")


@register("doc_8_grid_markdown", f"""
WITH {BOUNDS_SQL} SELECT c.doc_id, row + 1 AS line_no, '| ' || CAST(row AS VARCHAR) || ' | ' || string_agg(replace(value, '|', '\\|'), ' | ' ORDER BY col) || ' |' AS line
FROM cells c JOIN bounds b ON b.doc_id = c.doc_id WHERE row <= max_row AND col <= max_col GROUP BY 1, 2, row
UNION ALL SELECT doc_id, 0, '| _row/col_ | ' || array_to_string((ARRAY['A','B','C','D','E','F','G','H','I','J'])[1:max_col], ' | ') || ' |' FROM bounds
UNION ALL SELECT doc_id, 1, '| --- | ' || array_to_string(list_resize(['---'], max_col, '---'), ' | ') || ' |' FROM bounds""")
def _(spark, sf):
    return grids.grid_lines(cells(spark, sf)).select("doc_id", "line_no", "line")


SHOWN_SQL = CELLS_SQL + """, shown AS (SELECT *, row BETWEEN 2 AND 4 AND col BETWEEN 2 AND 3 AND NOT (row = 2 AND col = 2) AS covered FROM
    (SELECT * REPLACE (CASE WHEN doc_id % 4 = 3 THEN '' ELSE value END AS value), k % 9 = 0 AND doc_id % 4 <> 3 AS is_formula FROM cells)),
b AS (SELECT doc_id, max(row) AS max_row, max(col) AS max_col FROM shown WHERE NOT covered AND (value <> '' OR is_formula) GROUP BY 1)"""


@register("doc_8_sheet_text", f"""
WITH {SHOWN_SQL}, lines AS (
  SELECT s.doc_id, 0 AS part, row AS a, 0 AS b, '| ' || CAST(row AS VARCHAR) || ' | ' || string_agg(CASE WHEN covered THEN '' ELSE replace(value, '|', '\\|') END, ' | ' ORDER BY col) || ' |' AS line
  FROM shown s JOIN b ON b.doc_id = s.doc_id WHERE row <= max_row AND col <= max_col GROUP BY s.doc_id, row
  UNION ALL SELECT doc_id, 0, -1, 0, '| _row/col_ | ' || array_to_string((ARRAY['A','B','C','D','E','F','G','H','I','J'])[1:max_col], ' | ') || ' |' FROM b
  UNION ALL SELECT doc_id, 0, -1, 1, '| --- | ' || array_to_string(list_resize(['---'], max_col, '---'), ' | ') || ' |' FROM b
  UNION ALL SELECT doc_id, 1, 0, 0, chr(10) || '### Merged ranges' || chr(10) || chr(10) || '- `B2:C4`' FROM b
  UNION ALL SELECT DISTINCT s.doc_id, 2, -1, 0, chr(10) || '### Formula cells' || chr(10) || chr(10) || '| Cell | Formula | Cached value |' || chr(10) || '| --- | --- | --- |'
  FROM shown s JOIN b ON b.doc_id = s.doc_id WHERE is_formula AND NOT covered AND row <= max_row AND col <= max_col
  UNION ALL SELECT s.doc_id, 2, row, col, '| ' || chr(CAST(64 + col AS INTEGER)) || CAST(row AS VARCHAR) || ' | =A1 | ' || CASE WHEN value = '' THEN '_unavailable_' ELSE replace(value, '|', '\\|') END || ' |'
  FROM shown s JOIN b ON b.doc_id = s.doc_id WHERE is_formula AND NOT covered AND row <= max_row AND col <= max_col
  UNION ALL SELECT DISTINCT doc_id, 0, 0, 0, '_empty sheet_' FROM shown WHERE doc_id NOT IN (SELECT doc_id FROM b))
SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY part, a, b)) AS text_sha, count(*) > 1 AS filled FROM lines GROUP BY doc_id""")
def _(spark, sf):
    # one sheet in four is empty
    blank = F.col("doc_id") % 4 == 3
    some = cells(spark, sf).withColumns({"value": F.when(blank, "").otherwise(F.col("value")), "formula": F.when(~blank, F.col("formula"))})
    out = grids.sheet_text(some, ranges(spark, sf))
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha"), (F.col("text") != "_empty sheet_").alias("filled"))


@register("doc_8_column_letters", """
WITH RECURSIVE n AS (SELECT p_partkey, p_partkey * 7919 AS rest, '' AS letters FROM part
  UNION ALL SELECT p_partkey, (rest - 1) // 26, chr(CAST(65 + (rest - 1) % 26 AS INTEGER)) || letters FROM n WHERE rest > 0)
SELECT p_partkey, letters FROM n WHERE rest = 0""")
def _(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", grids.column_letter(F.col("p_partkey") * 7919).alias("letters"))


@register("doc_9_coverage", f"""
WITH {CELLS_SQL} SELECT doc_id, count(DISTINCT sheet) AS sheet_count, count(*) FILTER (value <> '' OR k % 9 = 0) AS nonempty_cells, 1 AS merged_ranges,
  count(*) FILTER (k % 9 = 0) AS formula_cells, count(*) FILTER (k % 9 = 0 AND value = '') AS formula_values_missing,
  coalesce(string_agg('s!' || chr(CAST(64 + col AS INTEGER)) || CAST(row AS VARCHAR), '|' ORDER BY row, col) FILTER (k % 9 = 0 AND value = ''), '') AS omissions,
  CASE WHEN doc_id % 4 = 0 THEN 'legacy_xls_formula_unverified' WHEN count(*) FILTER (k % 9 = 0 AND value = '') > 0 THEN 'formula_value_unavailable' ELSE '' END AS issue
FROM cells WHERE NOT (row BETWEEN 2 AND 4 AND col BETWEEN 2 AND 3 AND NOT (row = 2 AND col = 2)) GROUP BY doc_id""")
def _(spark, sf):
    report = grids.coverage(cells(spark, sf), ranges(spark, sf)).withColumn("legacy", F.col("doc_id") % 4 == 0)
    out = grids.coverage_issues(report)
    return out.select("doc_id", "sheet_count", "nonempty_cells", "merged_ranges", "formula_cells", "formula_values_missing", "omissions",
                      F.transform("issues", lambda i: i["code"]).alias("issue"))


@register("doc_10_paragraph_lines", with_facts("""
SELECT k AS doc_id, p, CAST(j AS BIGINT) AS k, CASE WHEN k % 3 = 0 THEN '_p' || CAST(p AS VARCHAR) || ': (empty)_' WHEN k % 3 = 1 THEN '_p' || CAST(p AS VARCHAR) || '_ ' || nation
  WHEN j = 0 THEN '_p' || CAST(p AS VARCHAR) || '.1_ ' || nation WHEN j = 1 THEN '_p' || CAST(p AS VARCHAR) || '.2: (empty)_' ELSE '_p' || CAST(p AS VARCHAR) || '.3_  ' || region END AS line
FROM (SELECT *, k % 40 + 1 AS p FROM f) g, (VALUES (0), (1), (2)) x(j) WHERE j = 0 OR k % 3 = 2"""))
def _(spark, sf):
    df = keyed(spark, sf, p="k % 40 + 1", text="CASE k % 3 WHEN 0 THEN ' \\n ' WHEN 1 THEN nation || '  ' ELSE nation || ' \\r\\n \\n ' || region || ' \\n' END")
    return grids.paragraph_lines(df)


@register("doc_10_sections", with_facts(r"""
SELECT k AS doc_id, replace('## Story: header1.xml~~_p1_ ' || nation || '~~_p2_ ' || region || '~~## Story: footnotes.xml~~_p1_ ' || region
  || '~~## Text boxes~~### Text box 1~_source: document.xml_~~' || nation || '~~### Text box 2~_source: document.xml_~~' || region || '~'
  || CASE WHEN k % 3 = 0 THEN '~## Embedded images~~### Image 1: i.png~_source: document.xml#rId7; content is routed separately for image verification_~' ELSE '' END,
  '~', chr(10)) AS text FROM f"""))
def _(spark, sf):
    rows = [("story", 0, "header1.xml", 1, "nation"), ("story", 0, "header1.xml", 2, "region"), ("story", 1, "footnotes.xml", 1, "region"),
            ("text_box", 0, "document.xml", 1, "nation"), ("text_box", 0, "document.xml", 2, "region"), ("image", 0, "document.xml", 1, "nation")]
    made = F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("part_no"), F.lit(c).alias("part"), F.lit(d).alias("n"), F.expr(e).alias("text"))
                     for a, b, c, d, e in rows])
    df = keyed(spark, sf, nation="nation", region="region").select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*")
    df = df.filter((F.col("kind") != "image") | (F.col("doc_id") % 3 == 0)).withColumns({"file": F.lit("i.png"), "relation": F.lit("rId7")})
    return grids.section_lines(df).groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "k", "line"))), lambda x: x["line"]), "\n").alias("text"))


# ------------------------------------------------------------------ pages
PAGE_CHARS = 2000
PAGES_SQL = f"""
pg AS (SELECT doc_id, CAST(p AS BIGINT) AS page, text[(p - 1) * {PAGE_CHARS} + 1 : p * {PAGE_CHARS}] || CASE WHEN (doc_id + p) % 3 = 0 THEN ' 提 单 号' ELSE '' END
    || CASE WHEN (doc_id + p) % 5 = 0 THEN repeat('(cid:12)�', 120) ELSE '' END AS text
  FROM (SELECT doc_id, text, unnest(range(1, (greatest(length(text), 1) - 1) // {PAGE_CHARS} + 2)) AS p FROM documents)),
c AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS compact FROM pg),
q AS (SELECT doc_id, page, text, length(compact) AS char_count, CASE WHEN (doc_id + page) % 5 = 0 THEN 240 ELSE 0 END / greatest(length(compact), 1) AS ratio,
  (doc_id + page) % 3 = 0 AS labelled FROM c)"""
OCR_SQL = """, o AS (SELECT *, char_count >= 50 AND ratio <= 0.05 AS good, (doc_id * 7 + page) % 4 AS r FROM q)"""
ROUTE_SQL = PAGES_SQL + OCR_SQL + """, routed AS (SELECT doc_id, page, CASE WHEN good THEN 'pdfplumber' WHEN r IN (0, 1) THEN 'vision' ELSE 'mineru' END AS parser,
  CASE WHEN NOT good AND r IN (0, 1) THEN 'low' ELSE 'high' END AS confidence, CASE WHEN good THEN text WHEN r = 0 THEN '' ELSE 'ocr ' || CAST(page AS VARCHAR) END AS markdown,
  CASE WHEN good THEN '' WHEN r = 0 THEN 'mineru_failed' WHEN r = 1 THEN 'mineru_low_confidence' ELSE '' END AS code FROM o)"""


def page_texts(spark, sf):
    """Documents cut into pages; some pages carry a label, some broken glyphs."""
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    whole = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PAGE_CHARS}}}"), F.lit(0))  # one walk over the text
    cut = docs.select("doc_id", F.posexplode(F.when(F.size(whole) > 0, whole).otherwise(F.array(F.lit("")))).alias("page", "part"))
    cut = cut.withColumn("page", F.col("page") + 1)
    key = F.col("doc_id") + F.col("page")
    return cut.select("doc_id", "page", F.concat(
        "part", F.when(key % 3 == 0, " 提 单 号").otherwise(""), F.when(key % 5 == 0, "(cid:12)�" * 120).otherwise("")).alias("text"))


def ocr_results(spark, sf):
    r = (F.col("doc_id") * 7 + F.col("page")) % 4
    return page_texts(spark, sf).select(
        "doc_id", "page", F.when(r == 0, "failed").otherwise("ok").alias("ocr_status"), F.concat(F.lit("ocr "), F.col("page").cast("string")).alias("ocr_text"),
        F.when(r == 1, F.array(F.lit("insufficient_text_blocks"))).otherwise(F.array().cast("array<string>")).alias("ocr_reasons"),
        F.when(r == 0, "Timeout").alias("ocr_error"))


def routed_pages(spark, sf):
    return pages.route_pages(pages.with_quality(page_texts(spark, sf)), ocr_results(spark, sf))


@register("doc_11_page_quality", f"""
WITH {PAGES_SQL} SELECT doc_id, page, char_count, round(ratio, 6) AS garbled_ratio, CASE WHEN labelled THEN '提单号' ELSE '' END AS key_labels,
  concat_ws('|', CASE WHEN char_count < 50 THEN 'text_below_minimum' END, CASE WHEN ratio > 0.05 THEN 'garbled_text_ratio' END) AS reasons FROM q""")
def _(spark, sf):
    return pages.with_quality(page_texts(spark, sf)).select("doc_id", "page", "char_count", F.round("garbled_ratio", 6).alias("garbled_ratio"), "key_labels", "reasons")


BOXES_SQL = """b AS (SELECT o_orderkey // 20 AS doc_id, o_orderkey % 20 AS idx, (o_orderkey * 37 + o_custkey) % 180 + 0.5 AS x0, (o_orderkey * 53 + o_custkey * 3) % 90 AS top,
  20 + o_custkey % 40 AS w, CASE WHEN o_custkey % 5 = 0 THEN 0.4 ELSE 6 + o_custkey % 9 END AS h FROM orders WHERE o_orderkey % 3 < 2)"""


def boxes(spark, sf):
    df = read_table(spark, sf, "orders").select(*[F.expr(e) for e in (
        "o_orderkey div 20 AS doc_id", "1 AS page", "o_orderkey % 20 AS idx", "CASE WHEN o_orderkey % 3 < 2 THEN '提 单号：' ELSE 'other' END AS text",
        "cast((o_orderkey * 37 + o_custkey) % 180 + 0.5 AS double) AS x0", "cast((o_orderkey * 53 + o_custkey * 3) % 90 AS double) AS top",
        "20 + o_custkey % 40 AS w", "cast(CASE WHEN o_custkey % 5 = 0 THEN 0.4 ELSE 6 + o_custkey % 9 END AS double) AS h")])
    return df.withColumn("x1", F.col("x0") + F.col("w")).withColumn("bottom", F.col("top") + F.col("h")).drop("w", "h")


@register("doc_12_label_overlap", f"""
WITH {BOXES_SQL} SELECT d.doc_id, EXISTS (SELECT 1 FROM b l JOIN b r ON l.doc_id = r.doc_id AND l.idx < r.idx WHERE l.doc_id = d.doc_id AND
  greatest(0, least(l.x0 + l.w, r.x0 + r.w) - greatest(l.x0, r.x0)) * greatest(0, least(l.top + l.h, r.top + r.h) - greatest(l.top, r.top))
  / least(greatest(1, l.w * l.h), greatest(1, r.w * r.h)) > 0.5) AS bbox_overlap FROM (SELECT DISTINCT o_orderkey // 20 AS doc_id FROM orders) d""")
def _(spark, sf):
    return pages.overlapping_pages(boxes(spark, sf)).select("doc_id", "bbox_overlap")


def block(**values):
    names = ("type", "category", "text", "content", "table_body", "table_content", "text_level", "level")
    return F.struct(*[(values.get(n, F.lit(None))).cast("string").alias(n) for n in names])


def ocr_blocks(spark, sf):
    turns = read_table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "turn", "text")
    return turns.withColumn("blocks", F.array(
        block(type=F.lit("Title"), text=F.lit(" Head ")), block(category=F.lit("text"), content=F.col("text"), text=F.lit("")),
        block(type=F.lit("image_caption"), text=F.lit("no")), block(type=F.lit("text"), text=F.lit("sub"), text_level=F.col("turn") % 8),
        block(type=F.when(F.col("turn") % 2 == 0, "table").otherwise("seal"), text=F.lit("<table>t</table>"))).cast(pages.BLOCKS_TYPE))


TURN_TEXT = r"""'# Head' || chr(10) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || CASE WHEN turn % 8 BETWEEN 1 AND 6 THEN repeat('#', CAST(turn % 8 AS INTEGER)) || ' ' ELSE '' END
  || 'sub' || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || '<table>t</table>' ELSE '' END"""


@register("doc_13_ocr_blocks", f"SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS doc_id, {TURN_TEXT} AS markdown FROM conversations")
def _(spark, sf):
    return ocr_blocks(spark, sf).select("doc_id", pages.blocks_text(F.col("blocks")).alias("markdown"))


def payloads(spark, sf):
    return keyed(spark, sf, payload="""CASE k % 4
      WHEN 0 THEN '{"data":[{"md_content":" "},{"x":{"markdown":"deep ' || k || '"}}],"z":{"md_content":"late"}}'
      WHEN 1 THEN '{"a":{"markdown":"inner"},"markdown_content":"own ' || k || '"}'
      WHEN 2 THEN '[{"results":{"content_list":"[{\\\\"type\\\\":\\\\"text\\\\",\\\\"text\\\\":\\\\"b' || k || '\\\\"}]"}},{"md_content":"m' || k || '"}]'
      ELSE '{"markdown":7,"md_content":{"n":1},"a":{"b":[{"c":{"d":[[{"e":{"markdown":null,"f":{"markdown":"level ' || k || '"}}}]]}}]}}' END""")


@register("doc_14_payload_markdown", with_facts("""
SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'deep ' || CAST(k AS VARCHAR) WHEN 1 THEN 'own ' || CAST(k AS VARCHAR) WHEN 2 THEN 'm' || CAST(k AS VARCHAR)
  ELSE 'level ' || CAST(k AS VARCHAR) END AS value FROM f"""))
def _(spark, sf):
    return pages.payload_markdown(payloads(spark, sf))


@register("doc_14_payload_blocks", with_facts("SELECT k AS doc_id, 'b' || CAST(k AS VARCHAR) AS text FROM f WHERE k % 4 = 2"))
def _(spark, sf):
    return pages.payload_blocks(payloads(spark, sf)).select("doc_id", pages.blocks_text(F.col("blocks")).alias("text"))


@register("doc_15_image_strip", r"""
SELECT doc_id, regexp_replace(regexp_replace(text || chr(10) || chr(10) || 'end', '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS markdown FROM documents""")
def _(spark, sf):
    df = read_table(spark, sf, "documents").withColumn("text", F.concat("text", F.lit("\n![alt text](http://x/y.png)\n<IMG src='a'>\nend")))
    return df.select("doc_id", pages.strip_images(F.col("text")).alias("markdown"))


@register("doc_16_ocr_confidence", f"""
WITH t AS (SELECT conv_id, turn, length(regexp_replace({TURN_TEXT}, '\\s+', '', 'g')) AS n FROM conversations)
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS doc_id, CAST(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS table_count,
  concat_ws('|', CASE WHEN n < 20 THEN 'insufficient_text_blocks' END, CASE WHEN turn % 2 = 1 THEN 'no_table_or_key_labels' END) AS reasons FROM t""")
def _(spark, sf):
    df = ocr_blocks(spark, sf)
    return df.select("doc_id", pages.ocr_confidence(pages.blocks_text(F.col("blocks")), F.col("blocks")).alias("x")).select("doc_id", "x.table_count", "x.reasons")


@register("doc_17_page_routing", f"WITH {ROUTE_SQL} SELECT doc_id, page, parser, confidence, sha256(markdown) AS markdown, code FROM routed")
def _(spark, sf):
    return routed_pages(spark, sf).select("doc_id", "page", "parser", "confidence", F.sha2("markdown", 256).alias("markdown"),
                                          F.transform("issues", lambda i: i["code"]).alias("code"))


@register("doc_17_image_routing", """
SELECT page_id AS doc_id, CASE WHEN page_id % 4 IN (0, 1) THEN 'vision' ELSE 'mineru' END AS parser,
  CASE page_id % 4 WHEN 0 THEN 'mineru_failed' WHEN 1 THEN 'mineru_low_confidence' ELSE '' END AS code, 'vision_only_unverified' AS off_code FROM pages""")
def _(spark, sf):
    r = F.col("doc_id") % 4
    images = read_table(spark, sf, "pages").select(F.col("page_id").alias("doc_id")).select(
        "doc_id", F.when(r == 0, "failed").otherwise("ok").alias("ocr_status"), F.lit("t").alias("ocr_text"), F.lit(None).cast("string").alias("ocr_error"),
        F.when(r == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("ocr_reasons"))
    on = pages.route_images(images).select("doc_id", "parser", F.transform("issues", lambda i: i["code"]).alias("code"))
    off = pages.route_images(images, ocr_enabled=False).select("doc_id", F.transform("issues", lambda i: i["code"]).alias("off_code"))
    return on.join(off, "doc_id")


@register("doc_18_assembly", f"""
WITH {ROUTE_SQL} SELECT doc_id, sha256(coalesce(string_agg(nullif(regexp_replace(markdown, '^\\s+|\\s+$', '', 'g'), ''), chr(10) || chr(10) ORDER BY page), '')) AS text,
  CASE WHEN min(parser) = max(parser) THEN min(parser) ELSE 'mixed' END AS parser, bool_or(confidence = 'low' OR code <> '') AS fallback, count(*) AS n_pages FROM routed GROUP BY doc_id""")
def _(spark, sf):
    return pages.assemble(routed_pages(spark, sf)).select("doc_id", F.sha2("text", 256).alias("text"), "parser", "fallback", F.size("page_routes").alias("n_pages"))


@register("doc_19_completeness", f"""
WITH {PAGES_SQL}, n AS (SELECT doc_id, max(page) AS n_pages FROM pg GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'no_pages' WHEN doc_id % 6 = 1 AND n_pages > 1 THEN 'page_gap' WHEN doc_id % 6 <> 1 AND n_pages > 10 THEN 'pdf_page_limit_exceeded' END AS error_code FROM n""")
def _(spark, sf):
    texts = page_texts(spark, sf)
    docs = texts.groupBy("doc_id").agg(F.max("page").alias("n")).select(
        "doc_id", F.when(F.col("doc_id") % 6 == 0, 0).otherwise(F.col("n")).alias("n_pages"))
    have = texts.select("doc_id", "page", F.lit(True).alias("needs_image")).filter(
        (F.col("doc_id") % 6 != 0) & ~((F.col("doc_id") % 6 == 1) & (F.col("page") > 1)))
    return pages.completeness(docs, have).select("doc_id", "error_code")


@register("doc_20_scan_test", r"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN true ELSE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 40 END AS scanned,
  CASE WHEN doc_id % 4 = 0 THEN 'empty_converted_content' END AS error_code FROM documents""")
def _(spark, sf):
    docs = read_table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, " \n").otherwise(F.col("text")).alias("text"))
    error = docs.select("doc_id", pages.empty_content_error(F.col("text")).alias("error_code"))
    return pages.scan_test(docs).select("doc_id", "scanned").join(error, "doc_id")


@register("doc_21_parser_issues", f"""
WITH {ROUTE_SQL} SELECT doc_id, page, 0 AS place, code, 'source.pages[' || CAST(page - 1 AS VARCHAR) || ']' AS field FROM routed WHERE code <> ''
UNION ALL SELECT doc_id, 0, 0, 'conversion_coverage_incomplete', 'source' FROM documents WHERE doc_id % 5 = 0""")
def _(spark, sf):
    own = read_table(spark, sf, "documents").select("doc_id", iss.issue_when(
        F.col("doc_id") % 5 == 0, "conversion_coverage_incomplete", "source", D.MESSAGES["coverage_incomplete"]).alias("issues"))
    return pages.review_issues(own, routed_pages(spark, sf)).select("doc_id", F.col("seq.rank").alias("page"), F.col("seq.pos").alias("place"), "code", "field")


@register("doc_22_image_pages", """
SELECT doc_id, 1 AS page, 'local' AS parser, CASE WHEN doc_id % 3 = 0 THEN 'embedded_image_unprocessed' ELSE '' END AS codes, doc_id % 3 <> 0 AS complete FROM documents
UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) + 1 AS INTEGER), 'mineru', 'embedded_image_requires_review', doc_id % 3 <> 0
FROM documents, (VALUES (0), (1), (2)) x(i) WHERE NOT (doc_id % 3 = 0 AND i = 1)""")
def _(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    first = docs.select("doc_id", F.lit(1).alias("page"), F.lit("local").alias("parser"), F.lit("high").alias("confidence"), F.col("text").alias("markdown"), iss.no_issues().alias("issues"))
    images = docs.select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("img")).select(
        "doc_id", "img", F.concat(F.lit("i"), F.col("img").cast("string"), F.lit(".png")).alias("file"), F.lit("word/document.xml").alias("part"),
        (~((F.col("doc_id") % 3 == 0) & (F.col("img") == 1))).alias("ok"), F.lit("bad_request").alias("error"), F.lit("mineru").alias("parser"),
        F.lit("high").alias("confidence"), F.lit("ocr").alias("markdown"), iss.no_issues().alias("issues"))
    coverage = docs.select("doc_id", F.lit(True).alias("complete"), F.array().cast("array<string>").alias("omissions"))
    out, report = pages.add_image_pages(first, images, coverage)
    return out.join(report.select("doc_id", "complete"), "doc_id").select("doc_id", "page", "parser", F.transform("issues", lambda i: i["code"]).alias("codes"), "complete")


@register("doc_23_conversion_status", """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'converted' ELSE 'needs_review' END AS status FROM documents""")
def _(spark, sf):
    r = F.col("doc_id") % 4
    return read_table(spark, sf, "documents").select("doc_id", pages.conversion_status(
        F.when(r == 0, 1).otherwise(0), F.when(r == 1, "").otherwise(F.col("text")), F.when(r == 2, F.lit(False))).alias("status"))


@register("doc_24_image_evidence", f"""
WITH i AS (SELECT page_id // 3 AS doc_id, CAST(strlen(html) AS BIGINT) * 300 AS n, page_id // 3 % 2 = 0 AS fallback FROM pages)
SELECT doc_id, CASE WHEN NOT bool_or(fallback) THEN 'text_confident' WHEN sum(n) > {D.MAX_IMAGE_BYTES} THEN 'text_oversize' ELSE 'image_high' END AS evidence_mode,
  CASE WHEN NOT bool_or(fallback) THEN 'vision_cross_check_skipped' WHEN sum(n) > {D.MAX_IMAGE_BYTES} THEN 'vision_image_too_large' ELSE '' END AS code FROM i GROUP BY 1""")
def _(spark, sf):
    images = read_table(spark, sf, "pages").select(F.expr("page_id div 3").alias("doc_id"), F.lit("mineru").alias("parser"),
                                                   F.expr("page_id div 3 % 2 = 0").alias("fallback"), (F.octet_length("html").cast("bigint") * 300).alias("image_bytes"))
    return pages.evidence(images).select("doc_id", "evidence_mode", F.transform("issues", lambda i: i["code"]).alias("code"))


# ------------------------------------------------------------------ rendering
def records(spark, sf):
    """Reconciled records to render: some break a rule of the strict form."""
    df = keyed(spark, sf, doc_type="CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'ODD' ELSE 'BOOKING_NOTE' END", mbl_no="bill", carrier="line_carrier",
               etd="CASE WHEN k % 10 = 2 THEN 'soon' ELSE iso_date END", loading_time="iso_date || 'T08:00:00'", customer="title", file="'f' || k || '.docx'")
    df = blank_record(df).withColumns({
        "containers": items(item(type="'40HQ'"), item(type="'20GP'", qty="doc_id % 3", gross_weight_kg="doc_id + 0.5D")),
        "review_issues": iss.issue_when(F.col("doc_id") % 2 == 0, "missing_mbl_no", "mbl_no", "msg", F.array(F.lit("a"), F.lit("b"))),
        "order_mapping": F.struct(*[F.lit(None).cast("string").alias(k) for k in D.DISPLAY_MAPPING]),
        "source": F.lit(None).cast(SOURCE_TYPE), "doc_format": F.lit("docx"), "extracted_at": F.lit("now"), "ready_for_order": F.lit(None).cast("boolean"),
        "raw_text_snippet": F.lit(None).cast("string"), "bad_numbers": F.when(F.col("doc_id") % 15 == 3, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))})
    return df


OK_SQL = "k % 6 <> 1 AND k % 10 <> 2 AND k % 15 <> 3"


@register("out_1_display_keys", with_facts(f"""
SELECT k AS doc_id, CASE WHEN k % 6 = 0 THEN '未知' ELSE '订舱托书' END AS doc_type, line_carrier || '（接口原始值）' AS carrier, '1|' || CAST(k % 3 AS VARCHAR) AS qty,
  CASE WHEN k % 2 = 0 THEN 'missing_mbl_no' ELSE '' END AS codes FROM f WHERE {OK_SQL}"""))
def _(spark, sf):
    good, _ = render.strict(records(spark, sf))
    shown = render.display(good)
    return shown.select("doc_id", F.col("文档类型").alias("doc_type"), F.col("船公司").alias("carrier"), F.transform("集装箱", lambda c: c["箱量"]).alias("qty"),
                        F.transform("复核问题", lambda i: i["问题代码"]).alias("codes"))


@register("out_2_label_text", with_facts(f"""
SELECT k AS doc_id, concat_ws(chr(10), '提单号: ' || bill, '船公司: ' || line_carrier || '（接口原始值）', '船期: ' || iso_date, '做箱时间: ' || iso_date || 'T08:00:00', '客户: ' || title,
  '柜 1:', '箱型: 40HQ', '箱量: 1', '柜 2:', '箱型: 20GP', '箱量: ' || CAST(k % 3 AS VARCHAR), '毛重: ' || CAST(k AS VARCHAR) || '.5',
  CASE WHEN k % 2 = 0 THEN '下单校验: 需人工复核' || chr(10) || '复核项: msg（原文候选：a / b）' END) AS chat_text FROM f WHERE {OK_SQL}"""))
def _(spark, sf):
    good, _ = render.strict(records(spark, sf))
    return render.chat_text(good)


@register("out_3_strict_output", with_facts(f"""
SELECT k AS doc_id, concat_ws('|', CASE WHEN k % 6 = 1 THEN 'doc_type' END, CASE WHEN k % 10 = 2 THEN 'etd' END, CASE WHEN k % 15 = 3 THEN 'containers' END) AS violations,
  CASE WHEN {OK_SQL} THEN 'f' || CAST(k AS VARCHAR) || '.docx' END AS file FROM f"""))
def _(spark, sf):
    good, bad = render.strict(records(spark, sf))
    return good.select("doc_id", F.lit("").alias("violations"), "source.file").unionByName(
        bad.select("doc_id", F.array_join("violations", "|").alias("violations"), F.lit(None).cast("string").alias("file")))


# ------------------------------------------------------------------ evaluation
@register("evl_1_field_diff", with_facts("""
SELECT k AS doc_id, path, kind FROM (
  SELECT k, '$.bill' AS path, 'differs' AS kind FROM f WHERE k % 4 = 0 AND bill IS NOT NULL
  UNION ALL SELECT k, '$.items', 'length' FROM f WHERE k % 5 = 0
  UNION ALL SELECT k, '$.items[0].t', 'differs' FROM f WHERE k % 7 = 1) u"""))
def _(spark, sf):
    base = keyed(spark, sf, bill="bill", nation="nation").withColumn("items", F.array(F.struct(F.lit("a").alias("t")), F.struct(F.lit("b").alias("t"))))
    changed = base.withColumns({
        "bill": F.when(F.col("doc_id") % 4 == 0, F.concat("bill", F.lit("!"))).otherwise(F.col("bill")),
        "items": F.transform(F.when(F.col("doc_id") % 5 == 0, F.slice("items", 1, 1)).otherwise(F.col("items")), lambda x, i: F.struct(
            F.when((i == 0) & (F.col("doc_id") % 7 == 1), "z").otherwise(x["t"]).alias("t")))})
    whole = F.struct("bill", "nation", "items").alias("record")
    return evaluate.field_diffs(base.select("doc_id", whole), changed.select("doc_id", whole)).select("doc_id", "path", "kind")


@register("evl_1_tree_diff", with_facts("""
SELECT k AS doc_id, path, kind, expected, actual FROM (
  SELECT k, '$' AS path, 'missing' AS kind, CAST(NULL AS VARCHAR) AS expected, NULL AS actual FROM f WHERE k % 50 = 0
  UNION ALL SELECT k, '$.new', 'unexpected', NULL, '"' || region || '"' FROM f WHERE k % 50 > 0 AND k % 2 = 0
  UNION ALL SELECT k, '$.items', 'length', '3', '2' FROM f WHERE k % 50 > 0 AND k % 3 = 0
  UNION ALL SELECT k, '$.items[0].no', 'missing', CAST(k AS VARCHAR), NULL FROM f WHERE k % 50 > 0 AND k % 5 = 1
  UNION ALL SELECT k, '$.items[1].boxes[0].seal.by', 'differs', '"' || nation || '"', 'null' FROM f WHERE k % 50 > 0 AND k % 7 = 2
  UNION ALL SELECT k, '$.items[1].boxes[0].seal.more', 'unexpected', NULL, '[[1]]' FROM f WHERE k % 50 > 0 AND k % 7 = 2
  UNION ALL SELECT k, '$.items[1].boxes[1]', 'differs', '{"seal":{"by":"' || nation || '"}}', '"box"' FROM f WHERE k % 50 > 0 AND k % 11 = 3
  UNION ALL SELECT k, '$.deep[0][0][0].x.y.z', 'differs', 'true', '"true"' FROM f WHERE k % 50 > 0 AND k % 13 = 4) u"""))
def _(spark, sf):
    # JSON records of any shape: keys that come and go inside items, other kinds of values, numbers written in other ways
    def record(**parts: str) -> str:
        out = """'{<new>"n": <n>, "deep": [[[{"x": {"y": {"z": <z>}}}]]], "items": [{<own>"t": null}, {"boxes": [{"seal": {"by": <by>}}, <second>]}<third>]}'"""
        for name, text in parts.items():
            out = out.replace(f"<{name}>", f"' || {text} || '")
        return out

    nation = """'"' || nation || '"'"""
    second = """'{"seal": {"by": "' || nation || '"}}'"""
    own = """'"no": ' || k || ', '"""
    expected = record(new="''", n="k || '.50'", z="'true'", own=own, by=nation, second=second, third="""', {"t": 3}'""")
    actual = record(
        new="""CASE WHEN k % 2 = 0 THEN '"new": "' || region || '", ' ELSE '' END""", n="k || '.5e0'", z="""CASE WHEN k % 13 = 4 THEN '"true"' ELSE 'true' END""",
        own=f"CASE WHEN k % 5 = 1 THEN '' ELSE {own} END", by=f"""CASE WHEN k % 7 = 2 THEN 'null, "more": [[1]]' ELSE {nation} END""",
        second=f"""CASE WHEN k % 11 = 3 THEN '"box"' ELSE {second} END""", third="""CASE WHEN k % 3 = 0 THEN '' ELSE ', {"t": 3}' END""")
    df = keyed(spark, sf, expected=expected, actual=actual)
    found = evaluate.field_diffs(df.select("doc_id", F.col("expected").alias("record")), df.filter("doc_id % 50 > 0").select("doc_id", F.col("actual").alias("record")))
    # a record that is missing as a whole would show all of itself
    return found.select("doc_id", "path", "kind", F.when(F.col("path") != "$", F.col("expected")).alias("expected"), "actual")


@register("evl_2_fixture_integrity", """
SELECT doc_id AS "case", asset FROM documents, (VALUES ('document'), ('parsed')) a(asset) WHERE doc_id % 9 = 0 AND asset = 'parsed' OR doc_id % 9 = 1 AND asset = 'document'""")
def _(spark, sf):
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("case"), F.encode("text", "UTF-8").alias("content"))
    both = docs.withColumn("asset", F.explode(F.array(F.lit("document"), F.lit("parsed"))))
    manifest = both.select("case", "asset", F.sha2("content", 256).alias("sha256"))
    now = both.filter(~((F.col("case") % 9 == 1) & (F.col("asset") == "document"))).withColumn("content", F.when(
        (F.col("case") % 9 == 0) & (F.col("asset") == "parsed"), F.concat("content", F.lit(bytearray(b"x")))).otherwise(F.col("content")))
    return evaluate.broken_fixtures(now, manifest).select("case", "asset")


@register("evl_3_route_pinning", with_facts("""
SELECT k AS "case", concat_ws('|', CASE WHEN k % 4 = 0 THEN 'parser' END, CASE WHEN k % 6 = 0 THEN 'template_hint' END, CASE WHEN k % 10 = 0 THEN 'deterministic_mapper' END) AS wrong
FROM f WHERE k % 4 = 0 OR k % 6 = 0 OR k % 10 = 0"""))
def _(spark, sf):
    base = keyed(spark, sf, region="region").select(F.col("doc_id").alias("case"), F.lit("local").alias("parser"), F.lit(None).cast("string").alias("template_hint"), F.lit(False).alias("deterministic_mapper"))
    actual = base.withColumns({"parser": F.when(F.col("case") % 4 == 0, "mixed").otherwise(F.col("parser")),
                               "template_hint": F.when(F.col("case") % 6 == 0, "yuhai_table"),
                               "deterministic_mapper": F.col("case") % 10 == 0})
    return evaluate.route_mismatches(base, actual).select("case", "wrong")


