"""Shipping paperwork rendered from the star schema.

``FACTS`` are expressions over one order that both Spark and ANSI SQL read the
same way. The texts are built from them here; a check computes the same facts
from the base tables and never sees a text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.session import read_table

PREFIX_STRIP = "".join(D.CARRIER_PREFIXES)
CARRIER_WIDTH = 8
ORDERS_A_TASK = 100_000
CARRIER_STRIP = "".join(c.ljust(CARRIER_WIDTH) for c in D.CARRIER_PREFIXES.values())
KEY8 = "lpad(cast(k AS string), 8, '0')"
PREFIX = f"substr('{PREFIX_STRIP}', cast(k % 43 AS int) * 4 + 1, 4)"
Y, M, DAY = "cast(year(odate) AS string)", "cast(month(odate) AS string)", "cast(day(odate) AS string)"
ISO = f"{Y} || '-' || lpad({M}, 2, '0') || '-' || lpad({DAY}, 2, '0')"

FACTS = {
    "prefix": PREFIX,
    "prefix_carrier": f"trim(substr('{CARRIER_STRIP}', cast(k % 43 AS int) * {CARRIER_WIDTH} + 1, {CARRIER_WIDTH}))",
    # bill number as written: missing for k % 7 = 0, malformed for k % 11 = 0
    "bill": f"CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN {PREFIX} || '-' || {KEY8} ELSE {PREFIX} || {KEY8} END",
    "child_bill": f"CASE WHEN k % 3 = 1 THEN 'HB' || {KEY8} END",
    "title": "CASE WHEN k % 13 = 0 THEN NULL ELSE c_name END",
    "recipient": "'AGENT ' || substr('ABCDE', cast(k % 5 AS int) + 1, 1)",
    "vessel": "'STAR ' || nation",
    "voyage": "lpad(cast(k % 1000 AS string), 3, '0') || 'E'",
    "iso_date": ISO,
    # date in four spellings; an impossible day for k % 19 = 0
    "date_text": f"CASE WHEN k % 19 = 0 THEN {Y} || '-02-30' WHEN k % 4 = 0 THEN {ISO} "
                 f"WHEN k % 4 = 1 THEN {Y} || '年' || {M} || '月' || {DAY} || '日' "
                 f"WHEN k % 4 = 2 THEN {Y} || '/' || {M} || '/' || {DAY} "
                 f"ELSE substr({Y}, 3, 2) || '.' || {M} || '.' || {DAY} END",
    "true_date": f"CASE WHEN k % 19 = 0 THEN NULL ELSE {ISO} END",
    "line_carrier": "CASE WHEN k % 5 = 0 THEN 'LINE ' || substr('ABCDEFG', cast(k % 7 AS int) + 1, 1) END",
    "type1": "substr('20GP40HQ40GP45HC20RF40OT', cast(p1 % 6 AS int) * 4 + 1, 4)",
    "type2": "substr('20GP40HQ40GP45HC20RF40OT', cast(p2 % 6 AS int) * 4 + 1, 4)",
    "packages": "cast(k % 900 + 1 AS string)",
    "weight": "cast(k % 5000 + 100 AS string) || '.5'",
    "volume": "cast(k % 60 + 1 AS string) || '.25'",
    "room": "'room-' || cast(k % 97 AS string)",
}

ORDER_BASE_SQL = """
b AS (
  SELECT o.o_orderkey AS k, c.c_name, n.n_name AS nation, r.r_name AS region, CAST(o.o_orderdate AS DATE) AS odate,
         coalesce(l.n_lines, 0) AS n_lines, l.p1, l.p2, l.q1, l.q2
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, min(l_partkey) AS p1, max(l_partkey) AS p2,
                    CAST(min(l_quantity) AS BIGINT) AS q1, CAST(max(l_quantity) AS BIGINT) AS q2
             FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""
FACTS_SQL = ORDER_BASE_SQL + ",\nf AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in FACTS.items()) + " FROM b)"


def facts(spark: SparkSession, sf_dir: str, with_lines: bool = True) -> DataFrame:
    """One row per order with its facts; line values come from one partial aggregate."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), "o_custkey", F.to_date("o_orderdate").alias("odate"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"), "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    base = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("k", "c_name", "nation", "region", "odate"))
    if with_lines:
        lines = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
            F.count("*").alias("n_lines"), F.min("l_partkey").alias("p1"), F.max("l_partkey").alias("p2"),
            F.min("l_quantity").cast("bigint").alias("q1"), F.max("l_quantity").cast("bigint").alias("q2"))
        base = base.join(lines, "k", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    else:
        base = base.withColumns({n: F.lit(None).cast("bigint") for n in ("n_lines", "p1", "p2", "q1", "q2")})
    # text work is heavy per byte, and the rows made of one order are many times its size: a task gets a bounded number of
    # orders however small these are in bytes, so that nothing it sorts or collects by document grows with the tables
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(orders.count() / ORDERS_A_TASK))
    return base.repartition(tasks, "k").select("*", *[F.expr(e).alias(n) for n, e in FACTS.items()])


BOX_TEXT = ("CASE WHEN n_lines = 0 THEN NULL WHEN n_lines = 1 THEN cast(q1 AS string) || '*' || type1 "
            "WHEN k % 5 = 0 THEN cast(q1 AS string) || '*' || type1 || '+' || type1 || '*' || cast(q2 AS string) "
            "WHEN k % 2 = 0 THEN cast(q1 AS string) || '*' || type1 || '+' || type2 || '*' || cast(q2 AS string) "
            "ELSE type1 || 'x' || cast(q1 AS string) || ' ' || cast(q2 AS string) || '×' || type2 END")


def _part(label: str, value: str, end: str = "；") -> str:
    """SQL text of ``label：value；`` that is empty for a null value."""
    return f"coalesce('{label}：' || {value} || '{end}', '')"


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text orders ``(doc_id, content, roomId)``; titles repeat a label for k % 17 = 0."""
    text = " || ".join([
        _part("提单号", "bill"), f"CASE WHEN k % 17 = 0 THEN {_part('托运人', 'c_name')} ELSE '' END",
        f"coalesce('公司名称:' || title || ';', '')", "'船名航次： ' || vessel || ' V.' || voyage || chr(10)",
        _part("箱型箱量", BOX_TEXT), _part("件数", "packages"), _part("毛重", "weight"), _part("做箱时间", "date_text"),
        "'备注：；'", _part("目的港", "region")])
    return facts(spark, sf_dir).select(
        F.col("k").alias("doc_id"), F.expr(text).alias("content"), F.col("room").alias("roomId"))


# fields of a note in reading order: (label, fact or expression)
NOTE_FIELDS = (
    ("TO", "CASE WHEN k % 13 = 0 THEN NULL ELSE recipient END"),
    ("FM", "title"),
    ("日期", "date_text"),
    ("提单号", "bill"),
    ("子提单号", "child_bill"),
    ("船公司", "line_carrier"),
    ("船名航次", "vessel || ' / ' || voyage"),
    ("做箱时间", "iso_date || ' 08:30'"),
    ("船期", "CASE WHEN k % 6 = 0 THEN cast(month(odate) AS string) || '月' || cast(day(odate) AS string) || '日' ELSE date_text END"),
    ("托运人", "CASE WHEN k % 9 = 0 THEN NULL ELSE c_name || ' CO' END"),
    ("门点地址", "CASE WHEN k % 8 = 0 THEN NULL ELSE region || ' ROAD ' || cast(k % 300 AS string) END"),
    ("中转港", "CASE WHEN k % 10 = 0 THEN '见设备' WHEN k % 10 = 1 THEN region END"),
    ("箱型", "CASE WHEN n_lines > 0 THEN type1 END"),
    ("件数", "packages || ' CTNS'"),
    ("毛重", "weight || ' KGS'"),
    ("体积", "volume || ' CBM'"),
)
TITLES = ("做箱通知书", "运输委托书", "派车托书", "做箱委托书", "装箱通知 提箱 司机", "订单")
NOTE_TITLE = "CASE " + " ".join(f"WHEN k % 6 = {i} THEN '{x}'" for i, x in enumerate(TITLES)) + " END"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes ``(doc_id, file, layout, text)`` in three layouts: paragraphs, pipe table, HTML table."""
    base = facts(spark, sf_dir)
    present = F.filter(F.array(*[
        F.struct(F.lit(label).alias("label"), F.expr(e).alias("value")) for label, e in NOTE_FIELDS]),
        lambda x: x["value"].isNotNull())
    base = base.withColumn("_fields", present).withColumn("_title", F.expr(NOTE_TITLE))
    paragraph = F.concat(
        F.lit("_p1_ "), F.col("_title"), F.lit("\n_p2: (empty)_\n"),
        F.array_join(F.transform("_fields", lambda x, i: F.concat(
            F.lit("_p"), (i + 3).cast("string"), F.lit("_ "), x["label"], F.lit("： "), x["value"])), "\n"))
    pipe = F.concat(
        F.lit("## "), F.col("_title"), F.lit("\n| _row/col_ | A | B |\n| --- | --- | --- |\n"),
        F.array_join(F.transform("_fields", lambda x, i: F.concat(
            F.lit("| "), (i + 1).cast("string"), F.lit(" | "), x["label"], F.lit(" | "), x["value"], F.lit(" |"))), "\n"))
    html = F.concat(
        F.col("_title"), F.lit("\n<table>"),
        F.array_join(F.transform("_fields", lambda x: F.concat(
            F.lit("<tr><td>"), x["label"], F.lit("</td><td>"), x["value"], F.lit("</td></tr>"))), ""), F.lit("</table>\n"))
    layout = F.col("k") % 3
    return base.select(
        "*", F.col("k").alias("doc_id"),
        F.concat(F.lit("note-"), F.year("odate").cast("string"), F.lit("-"), F.col("k").cast("string"), F.lit(".docx")).alias("file"),
        layout.cast("int").alias("layout"),
        F.when(layout == 0, paragraph).when(layout == 1, pipe).otherwise(html).alias("text")).drop("_fields", "_title")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose answers ``(doc_id, pos, key, value)``: mixed spellings, aliases and canonical keys."""
    entries = (
        ("'文档类型'", "'做箱通知'"),
        ("CASE WHEN k % 2 = 0 THEN '提单号' ELSE 'mbl_no' END", "CASE WHEN k % 4 = 1 THEN NULL ELSE bill END"),
        ("CASE WHEN k % 2 = 0 THEN 'mbl_no' ELSE '主单号' END", "CASE WHEN k % 3 = 0 THEN NULL ELSE 'ALT' || " + KEY8 + " END"),
        ("'船 名 航 次'", "vessel || '/V. ' || voyage"),
        ("'船期'", "date_text"), ("'DATE'", "date_text"), ("'做箱日期'", "date_text || ' 8:30'"),
        ("'FM'", "title"), ("'customer'", "c_name"),
        ("'开港时间'", "iso_date"), ("'备注'", "CASE WHEN k % 2 = 0 THEN '轻放；' END"),
        ("'箱型箱量'", "cast(q1 AS string) || ' x ' || type1"), ("'件数'", "packages || 'CTNS'"),
        ("'门点地址'", "region || ' ROAD 1'"), ("'unknown key'", "'x'"),
    )
    return _entries(facts(spark, sf_dir), entries)


def _entries(base: DataFrame, entries, *ids: str) -> DataFrame:
    """Rows ``(doc_id, .., pos, key, value)`` of loose entries, given as expressions over the facts."""
    rows = F.array(*[F.struct(F.expr(key).alias("key"), F.expr(value).alias("value")) for key, value in entries])
    keep = [F.col("k").alias("doc_id"), *[F.expr(x) for x in ids]]
    return base.select(*keep, F.posexplode(rows).alias("pos", "e")).select(
        *[c for c in ("doc_id", "idx") if c == "doc_id" or ids], "pos", "e.key", "e.value")


#: What no candidate of ``answers`` has for some documents, and what is wrong with others.
NO_ANSWER, BAD_NUMBER, BAD_ISSUES, REPAIRED = "k % 29 = 0", "k % 23 = 0", "k % 31 = 0", "k % 62 = 0"
ITEMS, OWN_ISSUES = "k % 3 = 0", "k % 5 = 2"


def answers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Whole answers to the notes, with container items, review issues and their repair, as ``candidate_records`` takes them.

    Some notes have no answer, some an unreadable number or unreadable issues, half of these a repaired list.
    """
    base = facts(spark, sf_dir)
    entries = (
        ("'文档类型'", "'做箱通知'"), ("'提单号'", "CASE WHEN k % 4 = 1 THEN NULL ELSE bill END"), ("'船 名 航 次'", "vessel || '/V. ' || voyage"),
        ("'船期'", "date_text"), ("'DATE'", "date_text"), ("'做箱日期'", "date_text || ' 8:30'"), ("'FM'", "title"), ("'customer'", "c_name"),
        ("'开港时间'", "CASE WHEN k % 4 = 0 THEN iso_date END"),
        ("'备注'", "CASE k % 6 WHEN 1 THEN region WHEN 5 THEN region || '；轻放' END"),
        ("'箱型箱量'", "cast(q1 AS string) || ' x ' || type1"), ("'件数'", f"CASE WHEN {BAD_NUMBER} THEN '若干' ELSE packages || 'CTNS' END"),
        ("'门点地址'", "CASE WHEN k % 17 = 0 THEN NULL ELSE region || ' ROAD 1' END"),
    )
    first = (("'毛重'", "weight || ' KGS'"), ("'体积'", "volume || 'CBM'"))
    second = (("'箱型'", "type2"), ("'数量'", "'2'"), ("'件数'", "'7 PKGS'"), ("'毛重'", "'0'"), ("'PO号'", f"'PO' || {KEY8}"))
    issue = (("'问题代码'", "'document_value_unclear'"), ("'field'", "'remark'"), ("'原因'", "'see ' || k"), ("'候选值'", """'["a", "b"]'"""), ("'blocking'", "'no'"))
    invented = (("'code'", "'invented_code'"), ("'field'", "'vessel'"), ("'message'", "'x'"))
    broken = (("'code'", "'document_value_unclear'"), ("'field'", "' '"), ("'message'", "'x'"))
    repaired = (("'code'", "'document_value_unclear'"), ("'字段'", "'remark'"), ("'message'", "'repaired'"))
    answered = base.filter(f"NOT ({NO_ANSWER})")

    def listed(condition: str, *lists) -> DataFrame:
        out = None
        for i, one in enumerate(lists):
            rows = _entries(answered.filter(condition), one, f"{i} AS idx")
            out = rows if out is None else out.unionByName(rows)
        return out

    issues = listed(OWN_ISSUES, issue, invented).unionByName(listed(BAD_ISSUES, broken).withColumn("idx", F.lit(2)))
    return {"candidates": _entries(answered, entries), "item_rows": listed(ITEMS, first, second),
            "issue_rows": issues, "repaired_rows": listed(REPAIRED, repaired)}


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request-log entries made from the event stream; ``seq`` is the event id."""
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("req-"), F.col("event_id").cast("string"))).alias("request_id"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1")).alias("ip"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 192.168.0."), (F.col("user_id") % 100).cast("string"), F.lit(" , 10.1.1.1"))).alias("x_forwarded_for"),
        F.lit("agent").alias("user_agent"), F.lit("POST").alias("method"),
        F.when(F.col("event_id") % 50 == 0, "/api/logs").otherwise(F.concat(F.lit("/Skills/"), "event_type")).alias("path"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("File_"), "event_type", F.lit(".PDF"))).alias("file"),
        (F.col("event_id") % 1000).alias("file_size"),
        F.col("props").alias("body"), F.lit(False).alias("body_truncated"),
        F.element_at(F.array(*[F.lit(s) for s in (200, 201, 302, 404, 422, 500)]), (F.col("event_id") % 6 + 1).cast("int")).alias("status"),
        F.lit(None).cast("string").alias("error_code"),
        F.lit(None).cast("struct<code:string,message:string,details:string>").alias("error"),
        F.round(F.col("value"), 1).alias("duration_ms"), F.col("ts"))
