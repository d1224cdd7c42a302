"""Queries of the reconciliation rules (REC) and of the full chain (ISS-8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.functions.plan import spread
from freightdocs.operators import issues as iss
from freightdocs.operators import pages
from freightdocs.operators import reconcile as rec
from freightdocs.plans import extract
from freightdocs.plans.catalog import blank_record, issue_lines, item, items, keyed, note_sql, register, with_facts
from freightdocs.session import read_table
from freightdocs.sources import corpus

K8 = corpus.KEY8


def record(spark, sf, with_lines=False, containers=(), cells=True, issues=None, **fields):
    """Working records from expressions over the facts; ``cells`` adds the lookup columns."""
    from freightdocs.plans.catalog import facts
    base = facts(spark, sf, with_lines).withColumn("doc_id", F.col("k"))
    columns = {n: F.expr(e) for n, e in fields.items()}
    if containers:
        columns["containers"] = items(*[item(**c) for c in containers])
    if issues is not None:
        columns["review_issues"] = F.array(*[iss.issue(
            F.expr(c), F.expr(f), F.expr(m), F.array(F.lit("seen")), blocking=b) for c, f, m, b in issues])
    df = base.select("doc_id", *[c.alias(n) for n, c in columns.items()])
    df = blank_record(df)
    if cells:
        return rec.begin(df)
    return df.withColumn("issues", F.col("review_issues"))


def factory(**parts):
    return F.struct(*[(F.expr(parts[k]) if k in parts else F.lit(None)).cast("string").alias(k) for k in ("name", "address", "contact", "phone")])


@register("rec_1_header_restore", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 13 = 0 THEN 'old recipient' ELSE recipient END AS recipient, coalesce(true_date, 'old date') AS doc_date,
  coalesce(line_carrier, 'old carrier') AS carrier, coalesce(title, 'old customer') AS customer, iso_date || 'T08:30:00' AS loading_time,
  CASE WHEN k % 13 = 0 THEN 'keep；old' ELSE 'keep' END AS remark FROM f""".replace("'keep；old'", "'keep；drop ' || recipient")))
def _(spark, sf):
    notes = corpus.notes(spark, sf)
    df = notes.select("doc_id", "text", F.concat(F.lit("keep；drop "), "recipient").alias("remark"), F.lit("old recipient").alias("recipient"),
                      F.lit("old date").alias("doc_date"), F.lit("old carrier").alias("carrier"), F.lit("old customer").alias("customer"))
    out = rec.restore_header(rec.begin(blank_record(df)))
    return out.select("doc_id", "recipient", "doc_date", "carrier", "customer", "loading_time", "remark")


@register("rec_2_partial_etd_year", with_facts("""
SELECT k AS doc_id, CASE k % 5 WHEN 4 THEN NULL ELSE CASE k % 5 WHEN 0 THEN '2020' WHEN 1 THEN '2021' WHEN 2 THEN '2022' ELSE '2023' END || '-03-07' END AS etd,
  k % 5 = 4 AS year_missing FROM f"""))
def _(spark, sf):
    df = record(spark, sf, text="'| 船期 | 3月7日 |' || (CASE WHEN k % 5 = 2 THEN ' no 2022 x' ELSE '' END)", doc_date="CASE WHEN k % 5 = 0 THEN '2020-01-01' END",
                internal_ref="CASE WHEN k % 5 <= 1 THEN 'REF2021' END", reference_year="CASE WHEN k % 5 = 3 THEN 2023 END", etd="'3月7日'")
    out = rec.restore_header(df)
    return out.select("doc_id", "etd", F.exists("issues", lambda i: i["code"] == "etd_year_missing").alias("year_missing"))


@register("rec_3_transit_port", with_facts("""
SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN region WHEN 1 THEN '见设备单' WHEN 2 THEN 'OLD' ELSE NULL END AS transit_port,
  k % 4 = 2 AS conflict FROM f"""))
def _(spark, sf):
    df = record(spark, sf, text="CASE k % 4 WHEN 0 THEN '中转港：' || region WHEN 1 THEN 'see 见设备单' WHEN 2 THEN '见设备单 note' ELSE 'none' END",
                transit_port="CASE WHEN k % 4 = 2 THEN 'OLD' END")
    out = rec.transit_port(rec.restore_header(df))
    return out.select("doc_id", "transit_port", F.exists("issues", lambda i: i["code"] == "conflicting_transit_port").alias("conflict"))


@register("rec_4_sender_contact", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'MR ' || region END AS sender_contact, k % 3 = 1 AS flagged FROM f"""))
def _(spark, sf):
    df = record(spark, sf, text="CASE k % 3 WHEN 0 THEN 'FROM：MR ' || region || '\\nFM：某某有限公司' WHEN 1 THEN 'FM：A\\nFROM：B' ELSE 'x' END",
                sender_contact="CASE WHEN k % 3 = 2 THEN NULL ELSE ' old ' END")
    out = rec.sender_contact(df)
    return out.select("doc_id", "sender_contact", (F.size("issues") > 0).alias("flagged"))


@register("rec_5_person_names", with_facts("""
SELECT k AS doc_id, concat_ws(';', CASE WHEN k % 3 = 1 THEN 'person_name_not_verbatim/sender/Z/true' WHEN k % 3 = 2 THEN 'person_name_unverified/sender/AA、BB/true' END,
  CASE WHEN k % 3 < 2 THEN 'person_name_not_verbatim/factory.contact/Q/true' ELSE 'person_name_unverified/factory.contact/Q/true' END) AS found FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, text="CASE WHEN k % 3 = 2 THEN NULL ELSE 'BB and AA' END", sender="CASE WHEN k % 3 = 1 THEN 'Z' ELSE 'AA、BB' END")
    df = df.withColumn("factory", factory(contact="'Q'"))
    return rec.person_names(df).select("doc_id", issue_lines(F.col("issues")).alias("found"))


@register("rec_6_child_bill", with_facts(f"""
SELECT k AS doc_id, CASE WHEN k % 4 = 3 THEN NULL ELSE 'HB' || {K8} END AS hbl_no, CASE WHEN k % 4 = 0 THEN NULL ELSE 'HB' || {K8} END AS mbl_no,
  CASE k % 4 WHEN 0 THEN 'hbl_misclassified_as_mbl' WHEN 1 THEN 'hbl_no_not_verbatim' WHEN 3 THEN 'hbl_no_not_verbatim' ELSE '' END AS codes FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, mbl_no=f"'HB' || {K8}", hbl_no=f"CASE k % 4 WHEN 1 THEN 'OTHER' WHEN 3 THEN 'GONE' ELSE 'HB' || {K8} END",
                text=f"CASE k % 4 WHEN 3 THEN 'none' ELSE '子提单号：HB' || {K8} END || (CASE WHEN k % 4 IN (1, 2) THEN ' 提单号 | x' ELSE '' END)")
    out = rec.child_bill(df)
    return out.select("doc_id", "hbl_no", "mbl_no", F.transform("issues", lambda i: i["code"]).alias("codes"))


@register("rec_7_shipper_company", with_facts("""
SELECT k AS doc_id, CASE k % 5 WHEN 0 THEN c_name WHEN 2 THEN 'FACT ' || nation WHEN 3 THEN '头程公司' END AS shipper_company,
  CASE k % 5 WHEN 0 THEN 'shipper_company_not_from_explicit_field' WHEN 1 THEN 'conflicting_shipper_company' WHEN 4 THEN 'shipper_company_not_from_explicit_field'
  ELSE 'shipper_company_not_from_explicit_field' END AS codes FROM f"""))
def _(spark, sf):
    df = record(spark, sf, shipper_company="'old'", template_hint="CASE k % 5 WHEN 2 THEN 'zuoxiang_std_esff' WHEN 3 THEN 'bolian_segway' END",
                text="'头程公司\\n' || (CASE k % 5 WHEN 0 THEN '托运人：' || c_name WHEN 1 THEN '发货人：A\\n托运人：B' WHEN 2 THEN '做箱工厂：FACT ' || nation ELSE 'x' END)",
                issues=[("'missing_shipper_company'", "'shipper_company'", "'m'", False)])
    out = rec.shipper_company(df)
    return out.select("doc_id", "shipper_company", F.transform(F.filter("issues", lambda i: i["code"] != "missing_shipper_company"), lambda i: i["code"]).alias("codes"))


@register("rec_8_container_identifiers", with_facts(f"""
SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'ABCD' || substr({K8}, 2) END AS container_no, CASE WHEN k % 2 = 0 THEN 'S-' || {K8} END AS seal_no,
  CASE WHEN k % 3 = 1 THEN '' ELSE 'no ' || 'ABCD' || substr({K8}, 2) || '；' END || 'keep' AS remark,
  concat_ws('|', CASE k % 3 WHEN 1 THEN 'container_no_not_verbatim' WHEN 2 THEN 'invalid_container_no' END, CASE WHEN k % 2 = 1 THEN 'invalid_seal_no' END) AS codes FROM f"""))
def _(spark, sf):
    number = f"'ABCD' || substr({K8}, 2)"
    df = record(spark, sf, cells=False, text=f"CASE WHEN k % 3 = 1 THEN 'x S-' || {K8} ELSE {number} || ' S-' || {K8} END",
                remark=f"'no ' || {number} || '; keep'",
                containers=[dict(container_no=f"CASE WHEN k % 3 = 2 THEN 'ab 1' ELSE {number} END", seal_no=f"CASE WHEN k % 2 = 0 THEN 'S-' || {K8} ELSE 'S 1' END")])
    out = rec.container_identifiers(df)
    return out.select("doc_id", F.get("containers", F.lit(0))["container_no"].alias("container_no"), F.get("containers", F.lit(0))["seal_no"].alias("seal_no"),
                      F.regexp_replace("remark", "; keep", "；keep").alias("remark"), F.transform("issues", lambda i: i["code"]).alias("codes"))


@register("rec_9_master_bill_recovery", with_facts(f"""
SELECT k AS doc_id, CASE k % 6 WHEN 0 THEN 'LAB' || {K8} WHEN 1 THEN 'TOK' || {K8} WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 'SEP' || {K8} ELSE 'HAD' END AS mbl_no,
  k % 6 IN (0, 1, 4) AS recovered FROM f"""))
def _(spark, sf):
    df = record(spark, sf, mbl_no="CASE WHEN k % 6 = 5 THEN 'HAD' END", vessel=f"CASE WHEN k % 6 = 3 THEN 'TOK' || {K8} END",
                text=f"CASE k % 6 WHEN 0 THEN '提单号：LAB' || {K8} || '\\nTOK' || {K8} WHEN 1 THEN '子单号：CHILD' || {K8} || '\\n1100CTNS 12345678 ABCDEFGH TOK' || {K8} "
                f"WHEN 2 THEN 'TOK' || {K8} || ' TIK' || {K8} WHEN 3 THEN 'TOK' || {K8} WHEN 4 THEN '主单号\\n\\nSEP' || {K8} ELSE 'TOK' || {K8} END")
    out = rec.master_bill(df)
    return out.select("doc_id", "mbl_no", F.exists("issues", lambda i: i["code"] == "mbl_no_by_format").alias("recovered"))


@register("rec_10_detail_over_summary", with_facts("""
SELECT k AS doc_id, CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n_items, CAST(CASE WHEN k % 3 = 0 THEN 4 ELSE 9 END AS BIGINT) AS qty, k % 3 <> 0 AS conflict FROM f"""))
def _(spark, sf):
    df = record(spark, sf, text="CASE k % 3 WHEN 0 THEN '总箱量：2*20GP+4x40HQ\\n| 箱型 | 40HQ*4 |' WHEN 1 THEN '总箱量：2*20GP+4x40HQ\\n箱型：40HQ*4、20GP*1' ELSE '箱型：40HQ*4' END",
                containers=[dict(type="'40''HQ'", qty="9"), dict(type="'20GP'", qty="2")],
                issues=[("'conflicting_container_data'", "'containers'", "'总箱量不一致'", True)])
    out = rec.detail_over_summary(df)
    return out.select("doc_id", F.size("containers").alias("n_items"), F.get("containers", F.lit(0))["qty"].alias("qty"), (F.size("issues") > 0).alias("conflict"))


@register("rec_11_type_restoration", with_facts("""
SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN '40HQ' WHEN 1 THEN '20GP' WHEN 2 THEN '40NOR' ELSE '40HC' END AS type1,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '45HC' WHEN 2 THEN '20GP' ELSE '40HQ' END AS type2,
  CASE k % 4 WHEN 0 THEN 'container_type_not_verbatim|missing_container_type' WHEN 1 THEN 'container_type_not_verbatim' WHEN 2 THEN 'unknown_container_type' ELSE '' END AS codes FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, text="CASE k % 4 WHEN 0 THEN '箱型 40 HQ &lt;' WHEN 1 THEN '20GP,45''HC A40HQ' WHEN 2 THEN '20GP 40HC 40HQ' ELSE '无' END",
                containers=[dict(type="CASE k % 4 WHEN 2 THEN '40 NOR' ELSE '40HC' END".replace("ELSE '40HC'", "WHEN 1 THEN '20GP' ELSE '40HC'")),
                            dict(type="CASE k % 4 WHEN 0 THEN ' ' WHEN 1 THEN '40HQ' WHEN 2 THEN '20GP' ELSE '40HQ' END")])
    out = rec.container_types(df)
    return out.select("doc_id", F.get("containers", F.lit(0))["type"].alias("type1"), F.get("containers", F.lit(1))["type"].alias("type2"),
                      F.transform("issues", lambda i: i["code"]).alias("codes"))


@register("rec_12_packages_unit", with_facts("""
SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN 'CARTONS' WHEN 1 THEN NULL ELSE NULL END AS unit FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, text="CASE k % 3 WHEN 0 THEN '1100 carton, CARTONS' WHEN 1 THEN '5 ctns 6 pkgs' ELSE '5 PCS' END",
                containers=[dict(packages_unit="NULL"), dict(packages_unit="CASE WHEN k % 3 = 2 THEN NULL ELSE 'BAGS' END")])
    return rec.packages_unit(df).select("doc_id", F.get("containers", F.lit(0))["packages_unit"].alias("unit"))


@register("rec_13_carrier_by_prefix", with_facts("""
SELECT k AS doc_id, CASE WHEN bill IS NULL THEN CASE WHEN k % 3 = 0 THEN NULL ELSE 'XX' END WHEN k % 3 = 2 THEN 'XX' ELSE prefix_carrier END AS carrier,
  bill IS NOT NULL AND k % 3 = 1 AS mismatch FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, mbl_no="lower(bill)", carrier="CASE WHEN k % 3 = 0 THEN NULL ELSE 'XX' END").withColumn(
        "carriers", F.when(F.col("doc_id") % 3 == 2, F.array(F.lit("XX"))).otherwise(F.col("carriers")))
    out = rec.carrier_by_prefix(df)
    return out.select("doc_id", "carrier", (F.size("issues") > 0).alias("mismatch"))


@register("rec_13_prefix_join", """
SELECT p.carrier, count(*) AS n FROM orders JOIN (SELECT * FROM (VALUES """ + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(D.CARRIER_PREFIXES.values())) + """) v(i, carrier)) p ON o_orderkey % 43 = p.i WHERE o_orderkey % 7 <> 0 GROUP BY 1""")
def _(spark, sf):
    # the table form: an equi join on the prefix with a broadcast dictionary
    bills = keyed(spark, sf, prefix="substr(bill, 1, 4)")
    return bills.join(F.broadcast(D.carrier_prefix_table(spark)), "prefix").groupBy("carrier").agg(F.count("*").alias("n"))


@register("rec_14_carrier_provenance", with_facts("""
SELECT k AS doc_id, CASE k % 5 WHEN 0 THEN 'Exact' WHEN 4 THEN NULL ELSE 'CAR' END AS carrier,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN bill IS NULL THEN 'carrier_source_unverified' ELSE 'carrier_by_mbl' END WHEN 2 THEN 'carrier_by_vessel' WHEN 3 THEN 'carrier_source_unverified' ELSE '' END AS codes FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, text="CASE WHEN k % 5 = 3 THEN NULL ELSE 'x' END", carrier="CASE k % 5 WHEN 4 THEN NULL ELSE ' car ' END",
                mbl_no="CASE WHEN k % 5 = 1 THEN bill END", vessel="CASE WHEN k % 5 = 2 THEN vessel END",
                issues=[("CASE WHEN k % 2 = 0 THEN 'carrier_by_mbl' ELSE 'carrier_by_vessel' END", "'carrier'", "'old'", False)]).withColumn(
        "carriers", F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("Exact"))).otherwise(F.col("carriers")))
    out = rec.carrier_provenance(df)
    return out.select("doc_id", "carrier", F.array_distinct(F.transform("issues", lambda i: i["code"])).alias("codes"))


@register("rec_15_inherit_bill", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'OWN' WHEN k % 3 = 1 THEN bill END AS item_bill FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, mbl_no="bill", containers=[dict(mbl_no="CASE WHEN k % 3 = 0 THEN 'OWN' END")])
    df = df.withColumn("containers", F.when(F.col("doc_id") % 3 == 2, F.concat("containers", "containers")).otherwise(F.col("containers")))
    return rec.inherit_bill(df).select("doc_id", F.get("containers", F.lit(0))["mbl_no"].alias("item_bill"))


@register("rec_16_indexed_remarks", with_facts("SELECT k AS doc_id, 'has' AS note1, region AS note2 FROM f"))
def _(spark, sf):
    df = record(spark, sf, cells=False, remark="'柜1：no；柜 2 的备注： ' || region || ' ；柜9：x'", containers=[dict(remark="'has'"), dict(type="'x'")])
    out = rec.indexed_remarks(df)
    return out.select("doc_id", F.get("containers", F.lit(0))["remark"].alias("note1"), F.get("containers", F.lit(1))["remark"].alias("note2"))


@register("rec_17_ocr_artefacts", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN region ELSE region || ' x' END AS remark, CASE WHEN k % 2 = 0 THEN 'confirmed_ocr_artifact/remark/作业资水/true' ELSE '' END AS found FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, remark="CASE WHEN k % 2 = 0 THEN region || ' 作业 资水！；' ELSE region || ' x' END")
    return rec.ocr_artefacts(df).select("doc_id", "remark", issue_lines(F.col("issues")).alias("found"))


@register("rec_18_grounding", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 4 = 3 THEN NULL ELSE nation || '；主值' || region END AS remark, CASE WHEN k % 4 = 3 THEN nation || '|主值' || region || '|invented' ELSE 'invented' END AS rejected FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, text="CASE WHEN k % 4 = 3 THEN NULL ELSE '_p1_ **' || lower(nation) || '**，<b>' || region || '</b> ![x](y)' END",
                remark="'备注：' || nation || '；主值' || region || '\\ninvented'")
    out = rec.grounded_remarks(df)
    return out.select("doc_id", "remark", F.get("issues", F.lit(0))["source_values"].alias("rejected"))


@register("rec_18_document_grounding", r"""
WITH t AS (SELECT doc_id, regexp_extract(text, '[A-Za-z]{4,}') AS word FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN word <> '' THEN word END AS remark, 'zz' || CAST(doc_id AS VARCHAR) || 'qq' AS rejected FROM t""")
def _(spark, sf):
    # whole document texts as sources: a word of the text is found in it, an invented one is not
    df = spread(read_table(spark, sf, "documents").select("doc_id", "text").filter("text IS NOT NULL"), "doc_id")
    word = F.regexp_extract("text", "[A-Za-z]{4,}", 0)
    both = blank_record(df.select("doc_id", "text", F.concat(word, F.lit("；zz"), F.col("doc_id").cast("string"), F.lit("qq")).alias("remark")))
    out = rec.grounded_remarks(both.withColumn("issues", iss.no_issues()))
    return out.select("doc_id", "remark", F.get("issues", F.lit(0))["source_values"].alias("rejected"))


@register("rec_19_conflict_markers", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'conflicting_container_data/containers[1]/' || region || '另一组/true' ELSE '' END AS found FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, containers=[dict(remark="region"), dict(remark="CASE WHEN k % 3 = 0 THEN region || '另一组' END")])
    return rec.conflict_markers(df).select("doc_id", issue_lines(F.col("issues")).alias("found"))


@register("rec_20_missing_measures", with_facts("""
SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'missing_container_measurements/containers[0]//true' WHEN 2 THEN 'missing_container_measurements/containers/seen/true'
  ELSE 'missing_container_measurements/containers[0]/seen/true' END AS found FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, text="CASE WHEN k % 4 = 2 THEN 'nothing' ELSE 'Volume' END",
                containers=[dict(packages="CASE WHEN k % 4 IN (0, 3) THEN 5 END", volume_cbm="CASE WHEN k % 4 IN (0) THEN 1.5 END")],
                issues=[("'missing_container_measurements'", "CASE k % 4 WHEN 0 THEN 'containers[0].packages' WHEN 3 THEN 'containers[0]' ELSE 'containers' END", "'m'", True)])
    return rec.missing_measures(df).select("doc_id", issue_lines(F.col("issues")).alias("found"))


@register("rec_21_required_fields", with_facts("""
SELECT k AS doc_id, title AS customer, concat_ws('|', CASE WHEN bill IS NULL THEN 'missing_mbl_no' END, CASE WHEN title IS NULL THEN 'missing_customer' END, CASE WHEN k % 2 = 0 THEN 'missing_loading_time' END,
  CASE WHEN bill IS NULL THEN 'missing_mbl_no' END, CASE WHEN k % 3 = 0 THEN 'missing_address' END) AS codes FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, customer="coalesce(' ' || title || ' ', '　')", loading_time="CASE WHEN k % 2 = 1 THEN '2020-01-01' END", mbl_no="bill",
                issues=[("'missing_mbl_no'", "'mbl_no'", "'old'", True)]).withColumn("factory", factory(address="CASE WHEN doc_id % 3 > 0 THEN 'road' END"))
    out = rec.required_fields(df)
    return out.select("doc_id", "customer", F.transform("issues", lambda i: i["code"]).alias("codes"))


@register("rec_22_order_note", with_facts(f"""
SELECT k AS doc_id, bill AS mbl_no, CASE k % 3 WHEN 0 THEN region || '；PO号：P1、P' || {K8} WHEN 1 THEN 'P1 P' || {K8} ELSE 'PO号：P1、P' || {K8} END AS c_note FROM f"""))
def _(spark, sf):
    df = record(spark, sf, cells=False, mbl_no="bill", remark=f"CASE k % 3 WHEN 0 THEN region WHEN 1 THEN 'P1 P' || {K8} END",
                containers=[dict(po_no="'P1'"), dict(po_no=f"'P' || {K8}"), dict(po_no="'P1'"), dict(po_no="''")])
    return rec.order_mapping(df).select("doc_id", "order_mapping.mbl_no", "order_mapping.c_note")


@register("rec_23_snippet", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text[1:200] END AS raw_text_snippet FROM documents")
def _(spark, sf):
    from freightdocs.session import read_table
    df = read_table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"))
    return rec.snippet(df).select("doc_id", "raw_text_snippet")


# ------------------------------------------------------------------ ISS-8 with OUT-3: notes and answers to strict records
# One row per note: every field of the strict record, or what is wrong with the answer. The facts decide each value:
# what the note states once wins over the answer, what neither has is an issue.
M = {name: D.MESSAGES[name] for name in ("non_positive", "no_mbl", "no_address", "type_missing", "type_restored", "bill_format", "ungrounded", "bill_recovered", "carrier_by_mbl", "image_ocr_failed")}


def _issue_sql(when: str, code: str, field: str, message: str, values: str, blocking: bool) -> str:
    return f"CASE WHEN {when} THEN '{code}/' || {field} || '/' || {message} || '/' || {values} || '/{str(blocking).lower()}' END"


ISSUES_SQL = ", ".join((
    _issue_sql("items", "missing_container_measurements", "'containers[1]'", f"'{M['non_positive']}'", "'gross_weight_kg=0.0'", True),
    _issue_sql("mbl IS NULL", "missing_mbl_no", "'mbl_no'", f"'{M['no_mbl']}'", "''", True),
    _issue_sql("k % 17 = 0", "missing_address", "'factory.address'", f"'{M['no_address']}'", "''", True),
    _issue_sql("n_lines = 0", "missing_container_type", "CASE WHEN items THEN 'containers' ELSE 'containers[0].type' END", f"'{M['type_missing']}'", "''", True),
    _issue_sql("k % 5 <> 0 AND mbl IS NOT NULL", "carrier_by_mbl", "'carrier'", f"'{M['carrier_by_mbl']}'", "mbl || ',' || prefix_carrier", True),
    _issue_sql("items AND type1 <> type2", "container_type_not_verbatim", "'containers[1].type'", f"'{M['type_restored']}'", "type2 || ',' || type1", False),
    _issue_sql(f"{corpus.BAD_ISSUES} OR {corpus.OWN_ISSUES}", "document_value_unclear", "'remark'",
               f"CASE WHEN {corpus.BAD_ISSUES} THEN 'repaired' ELSE 'see ' || CAST(k AS VARCHAR) END", f"CASE WHEN {corpus.BAD_ISSUES} THEN '' ELSE 'a,b' END", False).replace(
        "/false' END", f"/' || CASE WHEN {corpus.BAD_ISSUES} THEN 'true' ELSE 'false' END END"),
    _issue_sql("k % 4 <> 1 AND k % 11 = 0 AND bill IS NOT NULL", "invalid_mbl_no", "'mbl_no'", f"'{M['bill_format']}'", "bill", True),
    _issue_sql("k % 4 = 1 AND mbl IS NOT NULL", "mbl_no_by_format", "'mbl_no'", f"'{M['bill_recovered']}'", "mbl", True),
    _issue_sql("k % 37 = 5", "mineru_failed", "'source.pages[0]'", f"'{M['image_ocr_failed']}'", "'timeout'", True),
    _issue_sql("k % 4 = 0 OR k % 6 = 5", "ungrounded_text", "'remark'", f"'{M['ungrounded']}'", "CASE WHEN k % 4 = 0 THEN '开港时间：' || iso_date ELSE '轻放' END", True)))
ITEMS_SQL = """CASE WHEN NOT items THEN concat_ws('/', coalesce(type1, '-'), CAST(coalesce(q1, 1) AS VARCHAR), packages, 'CTNS', '-', '-', '-', coalesce(mbl, '-'))
  ELSE concat_ws('/', coalesce(type1, '-'), CAST(coalesce(q1, 1) AS VARCHAR), packages, 'CTNS', weight, volume, '-', '-') || ';' ||
    concat_ws('/', coalesce(type1, '-'), '2', '7', 'PKGS', '-', '-', 'PO' || lpad(CAST(k AS VARCHAR), 8, '0'), '-') END"""
NOTE_TEXT_SQL = f"""
titles AS (SELECT k, {corpus.NOTE_TITLE} AS title FROM b),
numbered AS (SELECT k, label, value, row_number() OVER (PARTITION BY k ORDER BY pos) AS n FROM nf),
texts AS (SELECT k, CASE k % 3 WHEN 0 THEN '_p1_ ' || any_value(titles.title) || chr(10) || '_p2: (empty)_' || chr(10)
      || string_agg('_p' || CAST(n + 2 AS VARCHAR) || '_ ' || label || '： ' || value, chr(10) ORDER BY n)
    WHEN 1 THEN '## ' || any_value(titles.title) || chr(10) || '| _row/col_ | A | B |' || chr(10) || '| --- | --- | --- |' || chr(10)
      || string_agg('| ' || CAST(n AS VARCHAR) || ' | ' || label || ' | ' || value || ' |', chr(10) ORDER BY n)
    ELSE any_value(titles.title) || chr(10) || '<table>' || string_agg('<tr><td>' || label || '</td><td>' || value || '</td></tr>', '' ORDER BY n) || '</table>' || chr(10) END AS text
  FROM numbered JOIN titles USING (k) GROUP BY k)"""
FULL_SQL = note_sql(f""", {NOTE_TEXT_SQL}, g AS (SELECT *, {corpus.ITEMS} AS items, CASE WHEN k % 11 <> 0 THEN bill END AS mbl,
  CASE WHEN k % 6 IN (1, 5) THEN region END AS kept_remark, CASE WHEN k % 9 = 0 THEN NULL ELSE c_name || ' CO' END AS shipper,
  concat_ws('|', CASE WHEN {corpus.NO_ANSWER} THEN 'no_candidate' WHEN {corpus.BAD_ISSUES} AND NOT ({corpus.REPAIRED}) THEN 'code, field, and message must be non-empty strings' END,
    CASE WHEN {corpus.BAD_NUMBER} AND NOT ({corpus.NO_ANSWER}) THEN 'containers' END) AS violations FROM f),
h AS (SELECT *, concat_ws(';', {ISSUES_SQL}) AS review_issues FROM g),
good AS (SELECT k AS doc_id, CASE k % 6 WHEN 0 THEN 'PACKING_NOTICE' WHEN 1 THEN 'TRANSPORT_ORDER' WHEN 2 THEN 'TRUCKING_ORDER' WHEN 3 THEN 'BOOKING_NOTE' WHEN 4 THEN 'TRUCKING_ORDER' ELSE 'PACKING_NOTICE' END AS doc_type,
  NULL AS internal_ref, NULL AS customs_declaration_no, NULL AS customer_ref, mbl AS mbl_no, child_bill AS hbl_no, vessel, voyage,
  CASE WHEN k % 5 = 0 THEN line_carrier WHEN mbl IS NOT NULL THEN prefix_carrier END AS carrier, NULL AS pol, NULL AS pod,
  CASE k % 10 WHEN 0 THEN '见设备' WHEN 1 THEN region END AS transit_port, NULL AS terminal,
  CASE WHEN k % 6 <> 0 AND k % 19 = 0 THEN date_text ELSE iso_date END AS etd, NULL AS si_cutoff, NULL AS customs_cutoff, iso_date || 'T08:30:00' AS loading_time,
  coalesce(title, c_name) AS customer, shipper AS shipper_company, NULL AS shipper_agent, CASE WHEN k % 13 <> 0 THEN recipient END AS recipient,
  CASE WHEN k % 19 = 0 THEN date_text ELSE iso_date END AS doc_date, NULL AS sender, title AS sender_contact, kept_remark AS remark,
  {ITEMS_SQL} AS containers, '-/' || CASE WHEN k % 17 = 0 THEN '-' ELSE region || ' ROAD 1' END || '/-/-' AS factory,
  concat_ws('/', '-', coalesce(mbl, '-'), coalesce(child_bill, '-'), coalesce(shipper, '-'), '-',
    coalesce(nullif(concat_ws('；', kept_remark, CASE WHEN items THEN 'PO号：PO' || lpad(CAST(k AS VARCHAR), 8, '0') END), ''), '-')) AS order_mapping,
  review_issues, review_issues NOT LIKE '%/true%' AS ready_for_order, concat_ws('/', 'note-' || CAST(year(odate) AS VARCHAR) || '-' || CAST(k AS VARCHAR) || '.docx', 'docx', '-', '-') AS source,
  text[1:200] AS raw_text_snippet, '' AS violations FROM h JOIN texts USING (k) WHERE violations = '')
SELECT * FROM good UNION ALL BY NAME SELECT k AS doc_id, violations FROM h WHERE violations <> ''""")


@register("iss_8_full_reconciliation", FULL_SQL)
def _(spark, sf):
    # every note is an image, and the OCR of some failed: their parser issue blocks records that are ready otherwise
    images = keyed(spark, sf, page="1", ocr_status="CASE WHEN k % 37 = 5 THEN 'failed' ELSE 'ok' END", ocr_text="nation", ocr_reasons="array()", ocr_error="'timeout'")
    parser_issues = pages.review_issues(images.select("doc_id", iss.no_issues().alias("issues")), pages.route_images(images))
    good, bad = extract.strict_records(corpus.notes(spark, sf), extract.candidate_records(**corpus.answers(spark, sf)), parser_issues)

    def shown(struct, *names) -> Column:
        return F.concat_ws("/", *[F.coalesce(struct[n].cast("string"), F.lit("-")) for n in names])

    item_parts = ("type", "qty", "packages", "packages_unit", "gross_weight_kg", "volume_cbm", "po_no", "mbl_no")
    unset = F.exists("containers", lambda c: F.coalesce(c["container_no"], c["seal_no"], c["remark"]).isNotNull())
    out = good.withColumns({
        "containers": F.when(~unset, F.array_join(F.transform("containers", lambda c: shown(c, *item_parts)), ";")),
        "factory": shown(F.col("factory"), "name", "address", "contact", "phone"),
        "order_mapping": shown(F.col("order_mapping"), "c_sn", "mbl_no", "hbl_no", "c_title", "factory_name", "c_note"),
        "source": shown(F.col("source"), "file", "doc_format", "template_hint", "extracted_at"),
        "review_issues": F.array_join(F.transform("review_issues", lambda i: F.concat_ws(
            "/", i["code"], i["field"], i["message"], F.array_join(i["source_values"], ","), i["blocking"].cast("string"))), ";"),
        "violations": F.lit("")})
    return out.unionByName(bad.select("doc_id", F.array_join("violations", "|").alias("violations")), allowMissingColumns=True)
