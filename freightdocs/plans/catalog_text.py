"""Queries of segmentation (SEG) and label lookup (LAB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightdocs.functions.plan import spread
from freightdocs.functions import text as t
from freightdocs.functions.plan import explode_rows
from freightdocs.operators import labels as lab
from freightdocs.operators import segments as seg
from freightdocs.plans.catalog import keyed, note_sql, register, with_facts
from freightdocs.session import read_table
from freightdocs.sources import corpus

NL = "chr(10)"


@register("seg_1_lines", r"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line
FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
      FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS parts FROM documents))""")
def _(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.concat(F.lit("_p"), F.col("doc_id").cast("string"), F.lit("_ "), F.col("text")).alias("text"))
    return seg.explode_lines(docs)


@register("seg_2_pipe_cells", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '---¦:---:' ELSE p_name || '¦a|b¦' || CAST(p_size AS VARCHAR) END AS cells,
       p_partkey % 5 = 0 AS separator FROM part""")
def _(spark, sf):
    part = read_table(spark, sf, "part").withColumn("line", F.expr(
        "CASE WHEN p_partkey % 5 = 0 THEN '| --- | :---: |' ELSE '| ' || p_name || ' | a\\\\|b | ' || p_size || ' |' END"))
    return part.withColumn("c", seg.pipe_cells(F.col("line"))).select(
        "p_partkey", F.array_join("c", "¦").alias("cells"), seg.is_separator(F.col("c")).alias("separator"))


@register("seg_3_html_cells", """
SELECT p_partkey AS doc_id, CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col,
       CASE WHEN r = 0 AND c = 0 THEN p_name || ' &—件中&lt;€&bogus;' WHEN r = 0 THEN p_type WHEN c = 0 THEN 'size' ELSE CAST(p_size AS VARCHAR) END AS cell
FROM part, (VALUES (0), (1)) a(r), (VALUES (0), (1)) b(c)""")
def _(spark, sf):
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(
        "'<TABLE border=1><tr class=\"a\"><td>' || p_name || ' &amp;&mdash;&#20214;&#x4E2D;&amp;lt;&#128;&bogus; <b></b></td><TH> <i>' || p_type || '</i></TH></tr>\n' || "
        "'<tr>\n<td>size</td><td>' || p_size || '\n</td></tr></TABLE>'").alias("text"))
    return seg.explode_cells(part, seg.html_rows(F.col("text")))


@register("seg_4_table_rows", note_sql("""
SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS row, CAST(c AS BIGINT) AS col,
       CASE WHEN c = 0 THEN label ELSE value END AS cell
FROM nf, (VALUES (0), (1)) x(c) WHERE k % 3 > 0""").replace(
    "row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS row", "dense_rank() OVER (PARTITION BY k ORDER BY pos) - 1 AS row"))
def _(spark, sf):
    notes = corpus.notes(spark, sf)
    return seg.explode_cells(notes, seg.table_rows(F.col("text")))


@register("seg_5_table_groups", note_sql("""
SELECT k AS doc_id, CAST(0 AS BIGINT) AS tbl, count(*) + CASE WHEN k % 3 = 1 THEN 2 ELSE 0 END AS n_rows
FROM nf WHERE k % 3 > 0 GROUP BY k"""))
def _(spark, sf):
    return explode_rows(corpus.notes(spark, sf), seg.table_groups(F.col("text")), "tbl", "rows").select(
        "doc_id", "tbl", F.size("rows").alias("n_rows"))


PAIR_FIELDS = (
    ("提单号", "bill"), ("托运人", "CASE WHEN k % 17 = 0 THEN c_name END"), ("公司名称", "title"),
    ("船名航次", "vessel || ' V.' || voyage"), ("箱型箱量", corpus.BOX_TEXT), ("件数", "packages"), ("毛重", "weight"),
    ("做箱时间", "date_text"), ("目的港", "CASE WHEN k % 4 = 0 THEN 'OVER' ELSE region END"))
PAIR_ROWS = " UNION ALL ".join(f"SELECT k, {i} AS p, '{a}' AS label, {e} AS value FROM f" for i, (a, e) in enumerate(PAIR_FIELDS))


@register("seg_6_label_pairs", with_facts(f"""
SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY p) - 1 AS pos, label, value
FROM ({PAIR_ROWS}) u WHERE value IS NOT NULL"""))
def _(spark, sf):
    texts = corpus.order_texts(spark, sf)
    repeated = F.when(F.col("doc_id") % 4 == 0, F.concat("content", F.lit("目的港：OVER"))).otherwise(F.col("content"))
    return explode_rows(texts, seg.label_values(repeated), "pos", "e").select(
        "doc_id", "pos", "e.label", "e.value")


@register("seg_7_header_companies", with_facts("""
SELECT k AS doc_id, 'CO' || CAST(k AS VARCHAR) || '有限公司|甲' || CAST(k % 10 AS VARCHAR) || '公司' AS companies FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, text="'# CO' || k || '有限公司\\n\\n  \\n_p3_ **甲' || (k % 10) || '公司**\\nplain\\n_p4_ CO' || k || "
               "'有限公司\\n4\\n5\\nLATE有限公司'")
    return df.select("doc_id", seg.header_companies(F.col("text")).alias("companies"))


@register("seg_8_notice_customers", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN '客' || CAST(k AS VARCHAR) WHEN k % 3 = 1 THEN region ELSE '' END AS customers FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, text="CASE WHEN k % 3 = 0 THEN '## 客' || k || '装箱通知' WHEN k % 3 = 1 THEN '_p1_ ' || region || "
               "'做箱通知书' ELSE '1\\n2\\n3\\n4\\n5\\n6\\n7\\n8\\n晚到装箱通知' END")
    return df.select("doc_id", seg.notice_customers(F.col("text")).alias("customers"))


@register("seg_9_numbered_notice", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 4 = 0 THEN NULL ELSE (CASE WHEN k % 2 = 1 THEN '提箱码：P' || CAST(k AS VARCHAR) || '；' ELSE '' END)
  || '1、' || nation || 'tail；2.' || region END AS remark FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, text="(CASE WHEN k % 2 = 1 THEN '提箱码： P' || k || ' \\n' ELSE '' END) || '_p1_ 请注意：\\nskip\\n' || "
               "(CASE WHEN k % 4 = 0 THEN '' ELSE '_l2_ 1、' || nation || '\\n\\ntail\\n2.' || region || '\\n' END) || '谢谢\\n3、no'")
    return df.select("doc_id", seg.numbered_notice(F.col("text")).alias("remark"))


@register("seg_10_remark_clauses", with_facts("""
SELECT k AS doc_id, region || '；' || nation || '；new' AS appended, nation AS dropped, region || '；' || nation AS labelled FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, region="region", nation="nation", remark="region || ' ;; ' || nation || '\\n'")
    return df.select(
        "doc_id", seg.append_clauses(F.col("remark"), F.array(F.lit("new"), F.col("region"), F.lit("new"))).alias("appended"),
        seg.drop_clauses_containing(F.col("remark"), F.array("region")).alias("dropped"),
        seg.drop_label_only_clauses(F.concat("remark", F.lit("；备注："))).alias("labelled"))


@register("seg_11_tokens", """
SELECT token, count(*) AS n, regexp_full_match(token, '[0-9]+[A-Za-z]{2,}') AS quantity_like
FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]{8,}')) AS token FROM documents) GROUP BY token""")
def _(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return (docs.select(F.explode(seg.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
            .withColumn("quantity_like", seg.looks_like_quantity(F.col("token"))))


@register("lab_1_label_key", """
SELECT p_partkey, lower(replace(p_name, ' ', '')) || '船公司' AS key FROM part""")
def _(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", t.label_key(
        F.concat(F.lit("　"), F.upper("p_name"), F.lit("船 公　司 ：:"))).alias("key"))


LAB2 = (("bill", ("提单号",)), ("customer", ("FM",)), ("date", ("日期", "DATE")), ("shipper", ("托运人", "SHIPPER")),
        ("loading", ("做箱时间",)), ("recipient", ("TO", "致")))
LAB2_LABEL = {"bill": "提单号", "customer": "FM", "date": "日期", "shipper": "托运人", "loading": "做箱时间", "recipient": "TO"}


@register("lab_2_adjacent_values", note_sql("""
SELECT k AS doc_id, CASE label WHEN '提单号' THEN 'bill' WHEN 'FM' THEN 'customer' WHEN '日期' THEN 'date' WHEN '托运人' THEN 'shipper'
  WHEN '做箱时间' THEN 'loading' ELSE 'recipient' END AS field, value FROM nf
WHERE label IN ('提单号', 'FM', '日期', '托运人', '做箱时间', 'TO')"""))
def _(spark, sf):
    df = lab.with_cells(corpus.notes(spark, sf))
    found = F.flatten(F.array(*[F.transform(lab.explicit_values(labels), _tag(name)) for name, labels in LAB2]))
    return explode_rows(df, found, "_pos", "x").select("doc_id", "x.*")


def _tag(name):
    return lambda x: F.struct(F.lit(name).alias("field"), x.alias("value"))


@register("lab_3_clean_values", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 4 = 0 THEN NULL ELSE nation END AS value FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, raw="CASE WHEN k % 8 = 0 THEN ' - ' WHEN k % 4 = 0 THEN '**/**' WHEN k % 4 = 1 THEN ' **' || nation || '** ' "
               "WHEN k % 4 = 2 THEN nation || '　件 数' || '：1' ELSE nation || '  船 公 司 ： x' END").withColumn(
        "raw", F.when(F.col("doc_id") % 4 == 2, F.replace("raw", F.lit("件 数"), F.lit("件数"))).otherwise(F.col("raw")))
    return df.select("doc_id", lab.clean_value_or_null(F.col("raw")).alias("value"))


@register("lab_4_column_values", with_facts("""
SELECT k AS doc_id, 'LINE ' || nation AS carrier, CASE WHEN k % 3 = 0 THEN region ELSE iso_date END AS etd FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, text="'intro\\n| 承运人 | 船期 |' || (CASE WHEN k % 3 = 0 THEN ' ' || region || ' |' ELSE '' END) || "
               "'\\n| --- | :---: |\\n| LINE ' || nation || ' | ' || iso_date || ' |\\n| later | later |\\ntail'")
    df = lab.with_cells(df)
    return df.select("doc_id", lab.column_values(("承运人",)).alias("carrier"), lab.column_values(("船期", "ETD")).alias("etd"))


@register("lab_5_separated_values", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 11 <= 8 THEN prefix || 'X' || CAST(k AS VARCHAR) ELSE '' END AS bill FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, text="'_p1_ 提 单 号：\\n' || repeat('_p2: (empty)_\\n', cast(k % 11 AS int)) || prefix || 'X' || k || "
               "'\\n主单号\\n备注：none'")
    return lab.with_cells(df).select("doc_id", lab.separated_values(("提单号", "主单号")).alias("bill"))


@register("lab_6_split_dates", with_facts("SELECT k AS doc_id, iso_date AS doc_date FROM f"))
def _(spark, sf):
    df = keyed(spark, sf, text="'| 日期：' || substr(cast(year(odate) AS string), 1, 2) || ' | **' || substr(cast(year(odate) AS string), 3, 2) || '.' || month(odate) || '/' || day(odate) || '** |'")
    return df.select("doc_id", lab.fragmented_dates(F.col("text")).alias("doc_date"))


@register("lab_7_recipient_extras", with_facts("SELECT k AS doc_id, nation || '|' || region AS extras FROM f"))
def _(spark, sf):
    df = keyed(spark, sf, text="'| 1 | 致： | X | ' || nation || ' | - | **' || region || '** |\\n| TO | only |'")
    return df.select("doc_id", lab.recipient_extras(F.col("text")).alias("extras"))


@register("lab_8_carriers", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'EMC CPS|' || nation ELSE nation END AS carriers FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, text="(CASE WHEN k % 2 = 0 THEN '船 公 司：EMC CPS  船期：1月2日\\n' ELSE '' END) || '| 承运人 | 船期 |\\n| ' || nation || ' | x |'")
    return lab.with_cells(df).select("doc_id", lab.carriers().alias("carriers"))


@register("lab_9_single_candidate", note_sql("""
SELECT f.k AS doc_id, CASE WHEN f.k % 17 = 0 THEN NULL ELSE v.value END AS bill
FROM f LEFT JOIN nf v ON v.k = f.k AND v.label = '提单号'""").replace(
    "CASE WHEN f.k % 17 = 0 THEN NULL ELSE v.value END", "CASE WHEN f.k % 17 = 0 AND v.value IS NOT NULL THEN NULL WHEN f.k % 17 = 0 THEN 'SECOND' ELSE v.value END"))
def _(spark, sf):
    notes = corpus.notes(spark, sf).select("doc_id", F.when(
        F.col("doc_id") % 17 == 0, F.concat("text", F.lit("\n提单号：SECOND\n提单号：SECOND"))).otherwise(F.col("text")).alias("text"))
    return lab.with_cells(notes).select("doc_id", lab.only(lab.explicit_values(("提单号",))).alias("bill"))


@register("lab_10_source_precedence", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 4 = 0 THEN 'FM ' || nation WHEN k % 4 = 1 THEN 'CUST ' || nation WHEN k % 4 = 2 THEN '某某' ELSE '头程公司' END AS customer,
  CASE WHEN k % 5 = 0 THEN 'AG ' || region ELSE '头程公司' END AS agent FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, text="'头程公司\\n' || (CASE WHEN k % 4 <= 2 THEN '某某装箱通知\\n' ELSE '' END) || (CASE WHEN k % 4 <= 1 THEN '客户：CUST ' || nation || '\\n' ELSE '' END)"
               " || (CASE WHEN k % 4 = 0 THEN 'FM\\n\\nFM ' || nation || '\\n' ELSE '' END) || (CASE WHEN k % 5 = 0 THEN '委托公司：AG ' || region ELSE '' END)")
    df = lab.with_cells(df)
    return df.select("doc_id", lab.customer_candidates(F.col("text")).alias("customer"), lab.agent_candidates(F.col("text")).alias("agent"))


@register("lab_11_first_label_value", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'HB/' || CAST(k AS VARCHAR) WHEN k % 3 = 1 THEN 'P.' || CAST(k AS VARCHAR) END AS child_bill FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, text="CASE WHEN k % 3 = 0 THEN '子单号 | WRONG\\n分提单号 ： HB/' || k || '，x' WHEN k % 3 = 1 THEN '| HBL NO | P.' || k || ' |' ELSE '提单号：NO' END")
    return df.select("doc_id", lab.labeled_value(F.col("text"), ("子提单号", "子单号", "分提单号", "分单号", "HBL NO", "HB/L")).alias("child_bill"))
