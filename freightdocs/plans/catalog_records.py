"""Queries of normalisation (NRM), routing and mapping (RTE), issues (ISS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.functions import values as v
from freightdocs.functions.plan import explode_rows

from freightdocs.operators import issues as iss
from freightdocs.operators import mapping, normalize, routing
from freightdocs.operators import segments as seg
from freightdocs.plans import extract
from freightdocs.plans.catalog import facts, keyed, register, values_sql, with_facts
from freightdocs.session import read_table
from freightdocs.sources import corpus

K8 = corpus.KEY8

# ------------------------------------------------------------------ normalisation
KV = (
    ("CASE WHEN k % 2 = 0 THEN '提单号' ELSE 'mbl_no' END", "CASE WHEN k % 4 = 1 THEN NULL ELSE bill END"),
    ("CASE WHEN k % 2 = 0 THEN 'mbl_no' ELSE '主单号' END", f"CASE WHEN k % 3 = 0 THEN NULL ELSE 'ALT' || {K8} END"),
    ("'master bl'", "'M' || " + K8), ("'船 名 航 次'", "vessel || '/V. ' || voyage"), ("'FM'", "title"), ("'from'", "c_name"),
    ("'customer'", "CASE WHEN k % 5 = 0 THEN NULL ELSE c_name END"), ("'客 户'", "region"), ("'unknown key'", "'x'"),
)
KV_SQL = " UNION ALL ".join(f"SELECT k, {i} AS pos, {a} AS key, {b} AS value FROM f" for i, (a, b) in enumerate(KV))
ALIASES = [(a, k) for k, aliases in D.TOP_ALIASES.items() for a in aliases]


@register("nrm_1_key_canonical", with_facts(f""", kv AS ({KV_SQL}), al AS {values_sql(ALIASES, 'alias, canonical')},
named AS (SELECT kv.*, coalesce(d.canonical, s.canonical, kv.key) AS field, s.canonical IS NULL AND coalesce(d.canonical, kv.key) = kv.key AS own
  FROM kv LEFT JOIN al d ON d.alias = kv.key LEFT JOIN al s ON d.alias IS NULL AND kv.key LIKE '% %' AND s.alias = replace(kv.key, ' ', '')),
owned AS (SELECT k, field, max(pos) AS own_pos, max(value) AS own_value FROM named WHERE own GROUP BY k, field)
SELECT n.k AS doc_id, n.field, CASE WHEN any_value(o.own_pos) IS NULL THEN arg_min(n.value, n.pos) FILTER (n.value IS NOT NULL)
  ELSE coalesce(any_value(o.own_value), arg_min(n.value, n.pos) FILTER (n.value IS NOT NULL AND n.pos > o.own_pos)) END AS value
FROM named n LEFT JOIN owned o ON o.k = n.k AND o.field = n.field GROUP BY n.k, n.field"""))
def _(spark, sf):
    rows = F.array(*[F.struct(F.expr(a).alias("key"), F.expr(b).alias("value")) for a, b in KV])
    kv = facts(spark, sf).select(F.col("k").alias("doc_id"), F.posexplode(rows).alias("pos", "e")).select(
        "doc_id", "pos", "e.key", "e.value")
    return normalize.canonical_fields(kv, D.alias_table(spark, "top"))


DAY_TIME = "|| 'T08:30:00'"


@register("nrm_2_record", with_facts(f"""
SELECT k AS doc_id, 'PACKING_NOTICE' AS doc_type, coalesce(true_date, date_text) AS etd, coalesce(true_date, date_text) AS doc_date,
  CASE WHEN k % 19 = 0 THEN date_text || ' 8:30' ELSE true_date {DAY_TIME} END AS loading_time, vessel, voyage, c_name AS customer,
  CASE WHEN k % 2 = 0 THEN '轻放；；' ELSE '' END || '开港时间：' || iso_date AS remark, region || ' ROAD 1' AS address FROM f"""))
def _(spark, sf):
    r = extract.candidate_records(corpus.candidates(spark, sf))
    return r.select("doc_id", "doc_type", "etd", "doc_date", "loading_time", "vessel", "voyage", "customer", "remark", "factory.address")


@register("nrm_3_leaked_items", with_facts("""
SELECT k AS doc_id, CAST(0 AS BIGINT) AS idx, CASE WHEN k % 3 = 0 THEN '20GP' ELSE type1 END AS type, q1 AS qty, CAST(packages AS BIGINT) AS packages,
  CASE WHEN k % 3 = 0 THEN 'BAGS' ELSE 'CTNS' END AS packages_unit FROM f WHERE n_lines > 0
UNION ALL SELECT k, 1, '40HQ', 5, NULL, NULL FROM f WHERE n_lines > 0 AND k % 3 = 0"""))
def _(spark, sf):
    base = facts(spark, sf, with_lines=True).filter("n_lines > 0")
    pick = [F.col("k").alias("doc_id"), *[F.lit(None).cast("string").alias(k) for k in ("container_no", "seal_no", "packages_unit", "gross_weight_kg", "volume_cbm")]]
    records = base.select(*pick, F.col("type1").alias("type"), F.col("q1").cast("string").alias("qty"), F.concat("packages", F.lit("CTNS")).alias("packages"))
    null = F.lit(None).cast("string")
    own = base.filter("k % 3 = 0").select(F.col("k").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("idx"), F.lit("20'GP").alias("type"), F.lit(None).cast("string").alias("qty"), F.lit("BAGS").alias("packages_unit")),
        F.struct(F.lit(1).alias("idx"), F.lit("40HQ").alias("type"), F.lit("5").alias("qty"), F.lit(None).cast("string").alias("packages_unit")))).alias("i"))
    loose = own.select("doc_id", "i.*").withColumns({k: null for k in normalize.CONTAINER_KEYS if k not in ("type", "qty", "packages_unit")})
    items = normalize.merge_leaked(records, normalize.normalize_item(loose))
    return items.select("doc_id", "idx", "type", "qty", "packages", "packages_unit")


@register("nrm_4_container_item", """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN '40HQ' ELSE '20gp' END AS type, CAST(p_size AS BIGINT) AS qty,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(1000 + p_size AS BIGINT) END AS packages, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'CTNS' END AS packages_unit,
  p_retailprice AS gross_weight_kg, CASE WHEN p_partkey % 3 = 0 THEN '1.5箱' ELSE '' END AS bad_numbers FROM part""")
def _(spark, sf):
    null = F.lit(None).cast("string")
    loose = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE '20 ’gp' END").alias("type"),
        F.expr("p_size || ' ＊ 40''HQ '").alias("container_type_qty"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN '1.5箱' ELSE '约 1,' || lpad(p_size, 3, '0') || ' ctns左右' END").alias("packages"),
        F.expr("p_retailprice || 'KGS'").alias("gross_weight_kg"),
        *[null.alias(k) for k in ("qty", "container_no", "seal_no", "packages_unit", "volume_cbm", "po_no", "mbl_no", "remark")])
    return normalize.normalize_item(loose).select("doc_id", "type", "qty", "packages", "packages_unit", "gross_weight_kg", "bad_numbers")


@register("nrm_5_numbers", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN -CAST(p_size AS DOUBLE) - 0.5 WHEN 2 THEN NULL ELSE 1000.0 + p_size END AS value,
  CASE p_partkey % 4 WHEN 0 THEN 'KG' WHEN 3 THEN 'CBM' END AS unit, CASE WHEN p_partkey % 4 IN (0, 3) THEN p_partkey % 4 = 3 OR true ELSE false END AS whole,
  CASE p_partkey % 4 WHEN 1 THEN -CAST(p_size AS DOUBLE) - 0.5 WHEN 3 THEN 1000.0 + p_size ELSE CAST(p_size AS DOUBLE) END AS first_number FROM part""")
def _(spark, sf):
    df = read_table(spark, sf, "part").withColumn("raw", F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN 'approx. ' || p_size || 'kg' WHEN 1 THEN '-' || p_size || '.5' WHEN 2 THEN 'no ' || p_size ELSE '大约1,' || lpad(p_size, 3, '0') || '　cbm以上' END"))
    number = v.clean_number(F.col("raw"), integral=False)
    return df.select("p_partkey", number["value"].alias("value"), number["unit"].alias("unit"),
                     v.clean_number(F.col("raw"), integral=True)["raw"].isNull().alias("whole"), v.first_number(F.col("raw")).alias("first_number"))


@register("nrm_6_dates", with_facts("""
SELECT k AS doc_id, coalesce(true_date, '　' || date_text) AS normalized, true_date AS parsed,
  CASE WHEN k % 19 = 0 THEN NULL ELSE true_date || 'T09:05:00' END AS parsed_time FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, d="date_text")
    return df.select(
        "doc_id", v.normalize_date(F.concat(F.lit("　"), F.col("d"))).alias("normalized"),
        v.parse_date(F.concat(F.lit("于 "), F.col("d"), F.lit(" 前"))).alias("parsed"),
        v.parse_date(F.concat(F.col("d"), F.lit(" 9：05 起")), allow_time=True).alias("parsed_time"))


@register("nrm_7_vessel_voyage", with_facts("""
SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN vessel || '/X' WHEN 1 THEN vessel WHEN 3 THEN vessel END AS vessel,
  CASE k % 4 WHEN 0 THEN voyage WHEN 1 THEN voyage WHEN 2 THEN 'VOY. ' || voyage END AS voyage FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, raw="CASE k % 4 WHEN 0 THEN vessel || '/X / v. ' || voyage WHEN 1 THEN ' ' || vessel || '　V. ' || voyage WHEN 2 THEN 'VOY. ' || voyage ELSE vessel END")
    return df.select("doc_id", v.split_vessel_voyage(F.col("raw")).alias("x")).select("doc_id", "x.*")


@register("nrm_8_type_qty", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 3 = 2 THEN NULL ELSE type1 END AS type, CASE WHEN k % 3 = 2 THEN NULL ELSE q1 END AS qty FROM f WHERE n_lines > 0"""))
def _(spark, sf):
    df = keyed(spark, sf, True, n="n_lines", raw="CASE k % 3 WHEN 0 THEN ' ' || q1 || ' × ' || substr(type1, 1, 2) || '''' || substr(type1, 3) || ' ' "
               "WHEN 1 THEN q1 || 'X' || type1 ELSE type1 || '*' || q1 END").filter("n > 0")
    return df.select("doc_id", v.split_type_qty(F.col("raw")).alias("x")).select("doc_id", "x.*")


@register("nrm_9_known_types", f"""
SELECT p_partkey AS doc_id, upper(substr(p_type, 1, 2)) || '40' AS code FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, '40NOR' FROM part WHERE p_partkey % 3 = 2""")
def _(spark, sf):
    df = read_table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(
        "CASE p_partkey % 3 WHEN 0 THEN '4 0''hq' WHEN 1 THEN substr(p_type, 1, 2) || '40' ELSE '40 nor' END").alias("type"))
    return normalize.unknown_types(df, D.container_type_table(spark)).select("doc_id", "code")


def loose_issues(spark, sf, repaired: bool = False):
    """Loose issue rows made from line items; some are malformed."""
    lines = read_table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("bigint").alias("q"))
    message = "'m'" if repaired else "CASE WHEN l_orderkey % 10 = 3 THEN ' ' ELSE 'm' END"
    return lines.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"),
        F.expr("CASE WHEN l_orderkey % 10 = 4 AND l_linenumber = 2 THEN 'unstructured_review_issue' ELSE ' c' || q % 5 END").alias("code"),
        F.expr("'f' || l_linenumber").alias("field"), F.expr(message).alias("message"),
        F.expr("CASE q % 3 WHEN 0 THEN '[\"a\",\"b\"]' WHEN 1 THEN 'single' END").alias("source_values"),
        F.expr("CASE q % 4 WHEN 0 THEN 'No' WHEN 1 THEN 'yes' END").alias("blocking"))


LOOSE_SQL = """WITH li AS (SELECT l_orderkey AS d, l_linenumber AS p, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
bad AS (SELECT DISTINCT d FROM li WHERE d % 10 = 3 OR (d % 10 = 4 AND p = 2)), still AS (SELECT DISTINCT d FROM li WHERE d % 10 = 4 AND p = 2)"""
GOOD_COLUMNS = """d AS doc_id, CAST(p AS BIGINT) AS seq, 'c' || CAST(q % 5 AS VARCHAR) AS code, 'f' || CAST(p AS VARCHAR) AS field,
  CASE q % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'single' ELSE '' END AS source_values, q % 4 <> 0 AS blocking"""


@register("nrm_10_issue_rows", f"{LOOSE_SQL} SELECT {GOOD_COLUMNS} FROM li WHERE d NOT IN (SELECT d FROM bad)")
def _(spark, sf):
    good, _ = normalize.normalize_issues(loose_issues(spark, sf))
    return good.drop("message")


@register("nrm_10_issue_errors", f"{LOOSE_SQL} SELECT d AS doc_id, CASE WHEN d % 10 = 3 THEN 'code, field, and message must be non-empty strings' ELSE 'unstructured_review_issue is not an allowed review issue code' END AS reason FROM bad")
def _(spark, sf):
    _, errors = normalize.normalize_issues(loose_issues(spark, sf))
    return errors.select("doc_id", "reason")


@register("nrm_11_issue_repair", f"""{LOOSE_SQL} SELECT d AS doc_id, count(*) AS n, false AS failed FROM li WHERE d NOT IN (SELECT d FROM still) GROUP BY d
UNION ALL SELECT d, 1, true FROM still""")
def _(spark, sf):
    good, errors = normalize.repair_issues(loose_issues(spark, sf), loose_issues(spark, sf, repaired=True))
    return good.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("failed", F.lit(False)).unionByName(
        errors.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("failed", F.lit(True)))


@register("nrm_12_ports", with_facts("""
SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN region || ', OH' WHEN 1 THEN region || ', USA' WHEN 2 THEN region || '(NEW YORK)' ELSE region END AS port FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, port="CASE k % 4 WHEN 0 THEN ' ' || lower(region) || ' ( OH )' WHEN 1 THEN region || ' ,USA' ELSE region END",
               text="CASE k % 4 WHEN 2 THEN 'x 目的港：' || lower(region) || ' (New York)' ELSE 'y' || region || '(ZZ)' END")
    return df.select("doc_id", normalize.port(F.col("port"), F.col("text")).alias("port"))


@register("nrm_13_measures", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 900 + 1 END AS packages, CAST(packages AS DOUBLE) + 0.125 AS gross_weight_kg,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 2.125 END AS volume_cbm,
  concat_ws('|', CASE WHEN k % 3 = 0 THEN 'packages=0' END, CASE WHEN k % 5 = 0 THEN 'volume_cbm=-1.5' END) AS bad FROM f"""))
def _(spark, sf):
    items = keyed(spark, sf, packages="CASE WHEN k % 3 = 0 THEN 0 ELSE k % 900 + 1 END", gross_weight_kg="k % 900 + 1 + 0.1251D",
                  volume_cbm="CASE WHEN k % 5 = 0 THEN -1.5D ELSE 2.1249D END").withColumn("idx", F.lit(0))
    clean, issues = normalize.sanitize_measures(items)
    return clean.join(issues.select("doc_id", F.array_join("source_values", "|").alias("bad")), "doc_id", "left").select(
        "doc_id", "packages", "gross_weight_kg", "volume_cbm", F.coalesce("bad", F.lit("")).alias("bad"))


@register("nrm_14_bills", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 11 = 0 THEN NULL ELSE bill END AS bill, k % 7 <> 0 AND k % 11 = 0 AS invalid FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, bill="' ' || bill || '　'")
    return df.select("doc_id", normalize.sanitized_bill(F.col("bill")).alias("bill"),
                     (F.size(normalize.bill_issue(F.col("bill"), "mbl_no", "mbl_no")) > 0).alias("invalid"))


@register("nrm_15_schema_dates", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 5 = 0 THEN NULL ELSE coalesce(true_date, date_text) END AS etd, k % 5 = 0 AS invalid,
  CASE WHEN k % 19 = 0 THEN NULL ELSE true_date || 'T10:20:30' END AS loading_time FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, etd="CASE WHEN k % 5 = 0 THEN 'soon' ELSE date_text END", loading="date_text || ' 10:20:30'")
    return df.select("doc_id", normalize.sanitized_date(F.col("etd")).alias("etd"),
                     (F.size(normalize.date_issue(F.col("etd"), "etd")) > 0).alias("invalid"),
                     normalize.sanitized_date(F.col("loading"), allow_time=True).alias("loading_time"))


# ------------------------------------------------------------------ routing
MARKER_TEXT = "CASE k % 14 " + " ".join(
    f"WHEN {i} THEN '" + " ".join(m.upper() if m.isascii() else m[:2] + "　" + m[2:] for m in markers) + "'" for i, (_, markers) in enumerate(D.TEMPLATE_MARKERS)
) + " WHEN 12 THEN '上海欣一捷' ELSE nation END"
TEMPLATE_CASE = "CASE k % 14 " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(D.TEMPLATE_MARKERS)) + " END"
TYPE_OF_TEMPLATE = "CASE k % 14 " + " ".join(
    f"WHEN {i} THEN '{x}'" for i, x in enumerate(("BOOKING_NOTE", "TRANSPORT_ORDER", "PACKING_NOTICE", "PACKING_NOTICE", "TRANSPORT_ORDER",
                                                   "PACKING_NOTICE", "BOOKING_NOTE", "TRANSPORT_ORDER", "TRUCKING_ORDER", "PACKING_NOTICE",
                                                   "BOOKING_NOTE", "PACKING_NOTICE"))) + " ELSE 'UNKNOWN' END"


@register("rte_1_templates", with_facts(f"SELECT k AS doc_id, {TEMPLATE_CASE} AS template FROM f"))
def _(spark, sf):
    df = keyed(spark, sf, text=MARKER_TEXT)
    return df.select("doc_id", routing.template_of(routing.route_key(F.col("text"))).alias("template"))


@register("rte_2_doc_types", with_facts("""
SELECT k AS doc_id, CASE k % 6 WHEN 0 THEN 'PACKING_NOTICE' WHEN 1 THEN 'TRANSPORT_ORDER' WHEN 2 THEN 'TRUCKING_ORDER' WHEN 3 THEN 'BOOKING_NOTE'
  WHEN 4 THEN 'TRUCKING_ORDER' ELSE 'UNKNOWN' END AS doc_type FROM f"""))
def _(spark, sf):
    notes = corpus.notes(spark, sf)
    return notes.select("doc_id", routing.doc_type_of(routing.route_key(F.col("text"))).alias("doc_type"))


@register("rte_3_fallback_override", with_facts(f"""
SELECT k AS doc_id, CASE WHEN ({TYPE_OF_TEMPLATE}) = 'UNKNOWN' THEN 'CANDIDATE' ELSE {TYPE_OF_TEMPLATE} END AS doc_type,
  CASE WHEN k % 3 = 0 THEN 'mapped' ELSE {TEMPLATE_CASE} END AS template_hint FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, text=MARKER_TEXT).withColumns({
        "doc_type": F.lit("CANDIDATE"), "mapped_template": F.when(F.col("doc_id") % 3 == 0, "mapped")})
    return routing.apply_route(routing.with_route(df, F.col("text"))).select("doc_id", "doc_type", "template_hint")


FP_JSON = '[["主单号","船名","航次"],["起运港","目的港","码头"],["箱型箱量","ETD","中转港代码"],["件数","毛重","体积"],["地址类型","地址","时间"]]'


def transport_notes(spark, sf):
    """Notes in the transport layout: five label rows, each with its value row."""
    text = (
        "'# 运输委托单\\n_p1_ 某某物流有限公司\\n| TO | ' || recipient || ' | 订单编号： | REF' || k || ' |\\n| 日期：' || substr(cast(year(odate) AS string), 1, 2) || ' | ' || "
        "(CASE WHEN k % 5 = 0 THEN 'xx' ELSE substr(cast(year(odate) AS string), 3, 2) || '.' || month(odate) || '.' || day(odate) END) || ' |\\n'"
        " || '| _row/col_ | A | B | C |\\n| --- | --- | --- | --- |\\n| 1 | 主单号 | 船名 | 航次： |\\n| 2 | ' || coalesce(bill, '未定') || ' | ' || vessel || ' | ' || voyage || ' |\\n'"
        " || '| 3 | 起运港 | 目的港 | 码头 |\\n| 4 | SHANGHAI | ' || region || ' |  |\\n| 5 | 箱型箱量 | ETD | 中转港代码 |\\n| 6 | 2*40HQ | ' || iso_date || ' |  |\\n'"
        " || '| 7 | 件数 | 毛重 | 体积 |\\n| 8 | ' || packages || ' CTNS | ' || weight || 'KGS | ' || volume || ' |\\n'"
        " || '| 9 | 地址类型 | ' || (CASE WHEN k % 7 = 3 THEN '地点' ELSE '地址' END) || ' | 时间 |\\n| 10 | 门点 | ' || nation || ' 13812345678 | ' || iso_date || ' 08:00:00 |'")
    return keyed(spark, sf, text=text)


MAPPED = "k % 7 <> 3 AND k % 5 <> 0 AND bill IS NOT NULL"


@register("rte_4_fingerprint", with_facts(f"""
SELECT k AS doc_id, CASE WHEN k % 7 = 3 THEN NULL ELSE sha256('{FP_JSON}') END AS fingerprint FROM f"""))
def _(spark, sf):
    df = transport_notes(spark, sf).select("doc_id", mapping.fingerprint(seg.table_rows(F.col("text"))).alias("p"))
    return df.select("doc_id", F.when(F.col("p") == mapping.TRANSPORT_FINGERPRINT, F.col("p")).alias("fingerprint"))


@register("rte_5_paired_values", with_facts("""
SELECT k AS doc_id, label, value FROM (SELECT k, '主单号' AS label, coalesce(bill, '未定') AS value FROM f UNION ALL SELECT k, '航次', voyage FROM f
  UNION ALL SELECT k, '目的港', region FROM f UNION ALL SELECT k, '体积', volume FROM f UNION ALL SELECT k, '时间', iso_date || ' 08:00:00' FROM f WHERE k % 7 <> 3) u"""))
def _(spark, sf):
    df = transport_notes(spark, sf).withColumn("pairs", mapping.paired_values(seg.table_rows(F.col("text"))))
    wanted = ("主单号", "航次", "目的港", "体积", "时间", "码头")
    rows = F.array(*[F.struct(F.lit(x).alias("label"), mapping.paired(F.col("pairs"), x).alias("value")) for x in wanted])
    return explode_rows(df, rows, "_pos", "r").select("doc_id", "r.*").filter("value IS NOT NULL")


def booking_notes(spark, sf):
    """Notes in the booking layout: inline cells for odd keys, label row above value row for even ones."""
    text = ("(CASE WHEN k % 3 = 0 THEN '内装箱 委托书\\n' ELSE 'note\\n' END) || (CASE WHEN k % 2 = 1 THEN '| 船 公 司 | ' || nation || ' | 船期 | ' || iso_date || ' |\\n| 中转港 | ' || region || ' | "
            "要求进港时间 | ' || (CASE WHEN k % 5 = 0 THEN '' ELSE 'MON' END) || ' |' ELSE '| 承运人 | 船期 | 卸港 | 要求进港 |\\n| --- | --- | --- | --- |\\n| ' || nation || ' | ' || iso_date || "
            "' | ' || region || ' | ' || (CASE WHEN k % 5 = 0 THEN '' ELSE 'MON' END) || ' |' END)")
    return keyed(spark, sf, text=text)


@register("rte_6_inline_or_below", with_facts("""
SELECT k AS doc_id, nation AS carrier, iso_date AS etd, region AS transit_port, CASE WHEN k % 5 = 0 THEN NULL ELSE 'MON' END AS remark FROM f"""))
def _(spark, sf):
    df = booking_notes(spark, sf)
    return df.select("doc_id", mapping.booking_values(seg.table_rows(F.col("text"))).alias("x")).select("doc_id", "x.*")


@register("rte_7_booking_layout", with_facts("SELECT k AS doc_id, 'neizhuang_booking' AS template, nation AS carrier FROM f WHERE k % 5 <> 0 OR k % 3 = 0"))
def _(spark, sf):
    df = mapping.with_template(booking_notes(spark, sf))
    return df.filter("mapped_template IS NOT NULL").select("doc_id", F.col("mapped_template").alias("template"), "booking.carrier")


@register("rte_8_transport_layout", with_facts(f"""
SELECT k AS doc_id, CASE WHEN {MAPPED} THEN 'bingsheng_transport' END AS template, CASE WHEN {MAPPED} THEN bill END AS mbl_no,
  CASE WHEN {MAPPED} THEN iso_date END AS doc_date, CASE WHEN {MAPPED} THEN nation END AS contact, CASE WHEN {MAPPED} THEN CAST(2 AS BIGINT) END AS qty,
  CASE WHEN {MAPPED} THEN '某某物流有限公司' END AS shipper,
  CASE WHEN k % 7 = 3 THEN '' ELSE concat_ws('|', CASE WHEN bill IS NULL THEN 'invalid_mbl_no' END, CASE WHEN k % 5 = 0 THEN 'invalid_doc_date' END) END AS errors FROM f"""))
def _(spark, sf):
    df = mapping.with_template(transport_notes(spark, sf))
    tr = F.col("transport")
    return df.select("doc_id", F.col("mapped_template").alias("template"), tr["mbl_no"].alias("mbl_no"), tr["doc_date"].alias("doc_date"),
                     tr["contact"].alias("contact"), tr["container"]["qty"].alias("qty"), tr["shipper_company"].alias("shipper"),
                     F.coalesce(F.array_join(F.get(F.col("mapped_issues"), F.lit(0))["source_values"], "|"), F.lit("")).alias("errors"))


LOCK = (("mbl_no", "bill", "CASE WHEN k % 4 = 0 THEN 'OTHER' ELSE bill END"), ("vessel", "vessel", "NULL"), ("pod", "NULL", "region"),
        ("etd", "CASE WHEN k % 3 = 0 THEN '' ELSE iso_date END", "true_date"), ("doc_type", "'UNKNOWN'", "'TRANSPORT_ORDER'"))


@register("rte_9_locked_merge", with_facts(", m AS (" + " UNION ALL ".join(
    f"SELECT k, '{p}' AS path, CAST({c} AS VARCHAR) AS cand, CAST({lk} AS VARCHAR) AS lock FROM f" for p, c, lk in LOCK) + """)
SELECT k AS doc_id, path, coalesce(lock, cand) AS value,
  CASE WHEN path <> 'doc_type' AND lock IS NOT NULL AND cand <> '' AND cand <> lock THEN cand || '|' || lock END AS conflict FROM m"""))
def _(spark, sf):
    base = facts(spark, sf)

    def side(which: int):
        rows = F.array(*[F.struct(F.lit(x[0]).alias("path"), F.expr(f"cast({x[which]} AS string)").alias("value")) for x in LOCK])
        return base.select(F.col("k").alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.*")
    merged, conflicts = mapping.merge_locked(side(1), side(2))
    shown = conflicts.select("doc_id", F.col("field").alias("path"), F.array_join("source_values", "|").alias("conflict"))
    return merged.join(shown, ["doc_id", "path"], "left")


@register("rte_10_factory_override", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN '常州' || nation ELSE 'old' END AS factory_name FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, text="'x：做箱通知\\n_p2_ ## 常州' || nation || '做箱通知 **\\n其他做箱通知'").withColumns({
        "factory": F.struct(F.lit("old").alias("name"), *[F.lit(None).cast("string").alias(k) for k in ("address", "contact", "phone")]),
        "template_hint": F.when(F.col("doc_id") % 2 == 0, "bolian_segway").otherwise("yuhai_table")})
    return mapping.factory_override(df).select("doc_id", F.col("factory.name").alias("factory_name"))


@register("rte_11_request_text", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'zuoxiang_std_esff' ELSE CASE WHEN k % 6 = 1 THEN 'xinjie_truck' ELSE 'bolian_tegewei_1' END END AS example,
  sha256('待抽取托书。' || chr(10) || 'file=f' || CAST(k AS VARCHAR) || chr(10) || 'doc_format=docx' || chr(10) || 'extracted_at=' || iso_date || chr(10) || chr(10) || '===== 文档内容开始 =====' || chr(10)
  || nation || chr(10) || '===== 文档内容结束 =====' || chr(10) || chr(10) || '请输出 JSON，source 字段用上述元数据填充。') AS request FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, nation="nation", file="'f' || k", at="iso_date", template="CASE WHEN k % 2 = 0 THEN 'neizhuang_booking' ELSE 'qide_door' END",
               doc_type="CASE WHEN k % 6 = 1 THEN 'TRUCKING_ORDER' ELSE 'BOOKING_NOTE' END")
    text = routing.request_text(F.col("nation"), F.col("file"), F.lit("docx"), F.col("at"))
    return df.select("doc_id", routing.example_name(F.col("doc_type"), F.col("template")).alias("example"), F.sha2(text, 256).alias("request"))


BOOKED = "(k % 5 <> 0 OR k % 3 = 0)"
NOTE_BEFORE = "以下 JSON 字段已经由高置信模板确定性映射锁定。只补充其中未覆盖的字段，不得改写锁定值；若原文看似冲突，保留锁定值并写入 blocking review_issues："


@register("rte_11_locked_booking", with_facts(f"""
SELECT k AS doc_id, CASE WHEN {BOOKED} THEN '{NOTE_BEFORE}' || chr(10) || '{{"carrier":"' || nation || '","etd":"' || iso_date || '","transit_port":"' || region || '"'
  || CASE WHEN k % 5 = 0 THEN '' ELSE ',"remark":"MON"' END || '}}' END AS locked FROM f"""))
def _(spark, sf):
    # requests with and without a template
    df = mapping.with_template(booking_notes(spark, sf))
    return df.select("doc_id", routing.locked_note(mapping.locked_json(F.col("booking"), F.col("transport"))).alias("locked"))


@register("rte_11_locked_transport", with_facts(f"""
SELECT k AS doc_id, CASE WHEN {MAPPED} THEN bill END AS mbl_no, CASE WHEN {MAPPED} THEN nation END AS contact, CASE WHEN {MAPPED} THEN 'TRANSPORT_ORDER' END AS doc_type,
  CASE WHEN {MAPPED} THEN iso_date END AS doc_date, CASE WHEN {MAPPED} THEN '2' END AS qty, CASE WHEN {MAPPED} THEN
    'doc_type|internal_ref|mbl_no|vessel|voyage|pol|pod|terminal|etd|transit_port|containers|factory|shipper_company|shipper_agent|recipient|doc_date|loading_time' END AS keys FROM f"""))
def _(spark, sf):
    df = mapping.with_template(transport_notes(spark, sf))
    own = df.select("doc_id", mapping.locked_json(F.col("booking"), F.col("transport")).alias("j"))
    parts = {"mbl_no": "$.mbl_no", "contact": "$.factory.contact", "doc_type": "$.doc_type", "doc_date": "$.doc_date", "qty": "$.containers[0].qty"}
    return own.select("doc_id", *[F.get_json_object("j", path).alias(n) for n, path in parts.items()], F.array_join(F.json_object_keys("j"), "|").alias("keys"))


# ------------------------------------------------------------------ issues
CODES = ("missing_mbl_no", "unknown_container_type", "carrier_by_mbl", "invented_code", "missing_loading_time")
ISSUE_SQL = """
WITH i AS (SELECT l_orderkey AS d, l_suppkey * 100000 + l_partkey * 10 + l_linenumber AS seq,
  (ARRAY['missing_mbl_no', 'unknown_container_type', 'carrier_by_mbl', 'invented_code', 'missing_loading_time'])[l_linenumber % 5 + 1] AS code,
  CASE WHEN l_partkey % 3 = 0 THEN 'mbl_no' ELSE 'containers[' || CAST(l_partkey % 3 - 1 AS VARCHAR) || '].type' END AS field,
  CAST(l_quantity AS BIGINT) AS q, l_partkey % 4 = 0 AS blocking FROM lineitem),
u AS (SELECT d, seq, min(code) AS code, min(field) AS field, min(q) AS q, bool_or(blocking) AS blocking FROM i GROUP BY d, seq)"""


def issue_table(spark, sf):
    """Issue rows made from line items; one row per place."""
    lines = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.element_at(F.array(*[F.lit(c) for c in CODES]), F.col("l_linenumber") % 5 + 1).alias("code"),
        F.expr("CASE WHEN l_partkey % 3 = 0 THEN 'mbl_no' ELSE 'containers[' || (l_partkey % 3 - 1) || '].type' END").alias("field"),
        F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_partkey") % 4 == 0).alias("blocking"))
    one = lines.groupBy("doc_id", "seq").agg(F.min("code").alias("code"), F.min("field").alias("field"), F.min("q").alias("q"), F.bool_or("blocking").alias("blocking"))
    return one.withColumns({"message": F.concat(F.lit("m"), F.col("seq").cast("string")),
                            "source_values": F.array((F.col("q") % 4).cast("string"), F.lit("v"))}).drop("q")


# values of a group in order of their first mention
VALUES_OF = """(SELECT {keys}, string_agg(val, '|' ORDER BY first_at, pos) AS source_values FROM (
  SELECT {keys}, val, min(seq) AS first_at, arg_min(pos, seq * 2 + pos) AS pos FROM (SELECT *, CAST(q % 4 AS VARCHAR) AS val, 0 AS pos FROM u UNION ALL SELECT *, 'v', 1 FROM u) x
  GROUP BY {keys}, val) y GROUP BY {keys})"""


@register("iss_1_append_merge", ISSUE_SQL + f"""
SELECT g.d AS doc_id, g.code, g.field, 'm' || CAST(max(g.seq) AS VARCHAR) AS message, bool_or(g.blocking) AS blocking, any_value(w.source_values) AS source_values
FROM u g JOIN {VALUES_OF.format(keys='d, code, field')} w ON w.d = g.d AND w.code = g.code AND w.field = g.field GROUP BY g.d, g.code, g.field""")
def _(spark, sf):
    return iss.append_merge(issue_table(spark, sf)).drop("seq")


MERGED_FIELD = """CASE WHEN min(g.field) = max(g.field) THEN min(g.field) WHEN min(g.field) LIKE 'containers%' THEN 'containers' ELSE 'multiple_fields' END"""


@register("iss_2_one_per_code", ISSUE_SQL + f"""
SELECT g.d AS doc_id, g.code, {MERGED_FIELD} AS field, 'm' || CAST(min(g.seq) AS VARCHAR) AS message, bool_or(g.blocking) AS blocking,
  any_value(w.source_values) AS source_values FROM u g JOIN {VALUES_OF.format(keys='d, code')} w ON w.d = g.d AND w.code = g.code GROUP BY g.d, g.code""".replace(
    "WHEN min(g.field) LIKE 'containers%' THEN", "WHEN max(g.field) LIKE 'containers%' AND min(g.field) LIKE 'containers%' THEN"))
def _(spark, sf):
    return iss.merge_by_code(issue_table(spark, sf)).drop("seq")


@register("iss_3_forced_blocking", ISSUE_SQL + """
SELECT d AS doc_id, seq, blocking OR code IN ('missing_mbl_no', 'carrier_by_mbl') AS blocking FROM u""")
def _(spark, sf):
    return iss.force_blocking(issue_table(spark, sf), D.issue_code_table(spark)).select("doc_id", "seq", "blocking")


@register("iss_4_known_codes", ISSUE_SQL + """, n AS (SELECT l_orderkey AS d, count(*) AS n FROM lineitem GROUP BY 1)
SELECT u.d AS doc_id, u.seq, u.code, CASE WHEN u.blocking THEN CASE WHEN n.n = 1 THEN 'containers[0].qty' ELSE 'containers.qty' END ELSE u.field END AS field
FROM u JOIN n ON n.d = u.d WHERE code <> 'invented_code'""")
def _(spark, sf):
    counts = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n_items"))
    rows = issue_table(spark, sf).withColumn("field", F.when(F.col("blocking"), "containers[].qty").otherwise(F.col("field")))
    return iss.keep_known(rows, D.issue_code_table(spark), counts).select("doc_id", "seq", "code", "field")


@register("iss_5_remove_by_key", ISSUE_SQL + """
SELECT d AS doc_id, seq, code FROM u WHERE NOT (code = 'missing_mbl_no' AND field = 'mbl_no' AND d % 2 = 0)""")
def _(spark, sf):
    keys = read_table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("doc_id"), F.lit("missing_mbl_no").alias("code"), F.lit("mbl_no").alias("field"))
    return iss.remove(issue_table(spark, sf), keys).select("doc_id", "seq", "code")


@register("iss_6_output_order", ISSUE_SQL + f"""
SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY CASE code WHEN 'missing_mbl_no' THEN 10 WHEN 'carrier_by_mbl' THEN 40 ELSE 50 END, code, field) AS place
FROM (SELECT g.d AS doc_id, g.code, {MERGED_FIELD} AS field FROM u g GROUP BY g.d, g.code) m""")
def _(spark, sf):
    merged = iss.merge_by_code(issue_table(spark, sf))
    return iss.ordered(merged, D.issue_code_table(spark)).select("doc_id", "code", "place")


@register("iss_7_readiness", ISSUE_SQL + """
SELECT o_orderkey AS doc_id, NOT coalesce(b, false) AS ready_for_order FROM orders LEFT JOIN (SELECT d, bool_or(blocking) AS b FROM u GROUP BY d) x ON x.d = o_orderkey""")
def _(spark, sf):
    return iss.readiness(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")), issue_table(spark, sf))
