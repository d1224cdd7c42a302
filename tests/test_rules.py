"""Small stated cases, one per rule family, in our own wording."""

from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.functions import values as v
from freightdocs.functions.text import clauses, strip, unescape_entities
from freightdocs.operators import grids, issues, labels, mapping, normalize, orders, pages, reconcile, routing, segments
from freightdocs.plans import extract
from freightdocs.plans.catalog import blank_record, item, items
from freightdocs.sources import requests


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(x).alias(n) for n, x in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def case(spark, rule, text=None, **fields):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(text).cast("string").alias("text"))
    for name, value in fields.items():
        df = df.withColumn(name, value if not isinstance(value, (str, type(None))) else F.lit(value).cast("string"))
    return rule(reconcile.begin(blank_record(df))).first()


def no_ranges(spark):
    return spark.createDataFrame([], "doc_id long, sheet string, r1 long, r2 long, c1 long, c2 long")


def codes(row, name="issues"):
    return [i["code"] for i in row[name]]


def test_blanks_include_the_ideographic_space(spark):
    assert one(spark, strip(F.lit("　 a 　"))) == "a"
    assert one(spark, clauses(F.lit("a；; b\n"))) == ["a", "b"]


def test_dates(spark):
    assert one(spark, v.normalize_date(F.lit("2026年7月5日"))) == "2026-07-05"
    assert one(spark, v.normalize_date(F.lit("2026-02-30"))) == "2026-02-30"
    assert one(spark, v.parse_date(F.lit("约21.5.28前"))) == "2021-05-28"
    assert one(spark, v.parse_date(F.lit("2026年7月15日0:05"), True)) == "2026-07-15T00:05:00"
    assert one(spark, v.parse_date(F.lit("13.13.13"))) is None


def test_numbers_and_types(spark):
    got = one(spark, v.clean_number(F.lit("约 1,200CTNS左右"), True))
    assert (got["value"], got["unit"]) == (1200.0, "CTNS")
    assert one(spark, v.clean_number(F.lit("1.5"), True))["raw"] == "1.5"
    got = one(spark, v.split_type_qty(F.lit("3 × 40'HQ")))
    assert (got["type"], got["qty"]) == ("40HQ", 3)


def test_an_escaped_pipe_stays_in_its_cell(spark):
    assert one(spark, segments.pipe_cells(F.lit(r"| a \| b | c |"))) == ["a | b", "c"]


def test_grid_and_cells_round_trip(spark):
    rows = [(1, "s", r, c, f"v{r}|{c}") for r in (1, 3) for c in (1, 2)]
    cells = spark.createDataFrame(rows, "doc_id long, sheet string, row long, col long, value string")
    text = grids.sheet_text(cells, no_ranges(spark)).select("doc_id", "text")
    got = text.select(segments.table_rows(F.col("text")).alias("x")).first()["x"]
    assert got == [["v1|1", "v1|2"], ["", ""], ["v3|1", "v3|2"]]


def test_label_values_keep_first_place_and_last_value(spark):
    got = one(spark, segments.label_values(F.lit("a：1；b: 2；a：3；c：")))
    assert [(x["label"], x["value"]) for x in got] == [("a", "3"), ("b", "2")]


def test_boxes_in_both_spellings(spark):
    got = one(spark, orders.boxes(F.lit("40HQ*3+2*20GP 0*45HC 1x40HQ")))
    assert [(b["b_type"], b["box_num"]) for b in got] == [("40HQ", 4), ("20GP", 2)]


def test_order_payload_and_rejects(spark):
    df = spark.createDataFrame([("提单号：ONEY00000042；托运人：某客户；船名航次：BLUE STAR V.012E", "r"), ("托运人：某客户", "r")], "content string, roomId string")
    ready, rejected = orders.gate(orders.extract(df))
    row = ready.select(requests.envelope(orders.order_data(F.col("extracted")), F.col("roomId")).alias("p")).first()["p"]
    assert '"b_ship_name":"BLUE STAR","b_ship_num":"012E"' in row and '"data":[{"b_order_num":"ONEY00000042"}]' in row
    assert [list(r["missing_fields"]) for r in rejected.collect()] == [["order_num1"]]


def test_key_order_decides_between_alias_and_canonical(spark):
    rows = [(1, 0, "提单号", "A"), (1, 1, "mbl_no", None), (2, 0, "mbl_no", None), (2, 1, "提单号", "A"), (3, 0, "提 单 号", "B"), (3, 1, "主单号", "C")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, key string, value string")
    got = {r["doc_id"]: r["value"] for r in normalize.canonical_fields(df, D.alias_table(spark, "top")).collect()}
    assert got == {1: None, 2: "A", 3: "B"}


def issue_rows(spark):
    rows = [(1, 10, "missing_mbl_no", "mbl_no", "m1", [], True), (1, 20, "unknown_container_type", "containers[0].type", "m2", ["40NOR"], False),
            (1, 30, "unknown_container_type", "containers[1].type", "m3", ["20SD"], False)]
    return spark.createDataFrame(rows, "doc_id long, seq long, code string, field string, message string, source_values array<string>, blocking boolean")


def test_one_issue_per_code_in_both_forms(spark):
    table = issues.merge_by_code(issue_rows(spark))
    second = {r["code"]: r for r in table.collect()}["unknown_container_type"]
    assert (second["field"], second["message"], second["source_values"], second["blocking"]) == ("containers", "m2", ["40NOR", "20SD"], False)
    again = {tuple(map(str, r)) for r in issues.merge_by_code(table).collect()}
    assert again == {tuple(map(str, r)) for r in table.collect()}
    log = issue_rows(spark).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "seq", "code", "field", "message", "source_values", "blocking"))), lambda x: F.struct(*[x[k].alias(k) for k in (
            "code", "field", "message", "source_values", "blocking")])).alias("log"))
    row = log.select(issues.one_per_code(issues.merge_keys(F.col("log"))).alias("m")).first()["m"]
    assert [(i["code"], i["field"]) for i in row] == [("missing_mbl_no", "mbl_no"), ("unknown_container_type", "containers")]
    ready = issues.readiness(issue_rows(spark).select("doc_id").distinct(), issue_rows(spark)).first()
    assert ready["ready_for_order"] is False


def test_merging_issues_does_not_depend_on_partitions(spark):
    rows = issue_rows(spark)
    spread = issues.append_merge(rows.repartition(4, "seq")).collect()
    assert sorted(map(str, spread)) == sorted(map(str, issues.append_merge(rows.coalesce(1)).collect()))


def test_routing(spark):
    key = routing.route_key(F.lit("装箱通知\n提箱：x 司机：y"))
    assert one(spark, routing.doc_type_of(key)) == "TRUCKING_ORDER"
    assert one(spark, routing.template_of(routing.route_key(F.lit("上海欣一捷 货物配舱 通知书")))) == "xinyijie_paira"


def test_adjacent_values_stop_at_the_next_label(spark):
    df = spark.createDataFrame([(1, "TO：A 公司  FM：B\n| 船公司 | 船期 |\n| X LINE | 2026-01-02 |")], "doc_id long, text string")
    row = labels.with_cells(df).select(
        labels.explicit_values(("TO",)).alias("to"), labels.explicit_values(("FM",)).alias("fm"),
        labels.explicit_values(("船公司",)).alias("none"), labels.carriers().alias("carriers")).first()
    assert (row["to"], row["fm"], row["none"], row["carriers"]) == (["A 公司"], ["B"], [], ["X LINE"])


def test_master_bill_is_recovered_once(spark):
    row = case(spark, reconcile.master_bill, "单号 ABCD12345678 1100CTNS 13812345678")
    assert row["mbl_no"] == "ABCD12345678" and codes(row) == ["mbl_no_by_format"]
    assert case(spark, reconcile.master_bill, "ABCD12345678 EFGH12345678")["mbl_no"] is None


def test_carrier_prefix_and_provenance(spark):
    row = case(spark, lambda d: reconcile.carrier_provenance(reconcile.carrier_by_prefix(d)), "x", mbl_no="ONEY12345678", carrier="MSC")
    assert row["carrier"] == "ONE" and codes(row) == ["carrier_prefix_mismatch", "carrier_by_mbl"]


def test_ungrounded_clauses_are_rejected(spark):
    row = case(spark, reconcile.grounded_remarks, "请 轻放，谢谢", remark="备注：轻放；编造")
    assert row["remark"] == "轻放" and row["issues"][0]["source_values"] == ["编造"]


def test_full_chain_on_a_small_note(spark):
    box = items(item(type="'40HQ'", qty="1", packages="10", volume_cbm="1.5D"))
    text = "FM：某客户\n提单号：ONEY12345678\n船公司：ONE LINE\n做箱时间：2026-01-02 08:00\n箱型：40HQ\n件数：10\n体积：1.5"
    base = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), box.alias("containers"),
                                 F.lit("ONEY12345678").alias("mbl_no"))
    base = base.withColumn("factory", F.struct(*[F.lit(x).cast("string").alias(k) for k, x in (
        ("name", None), ("address", "某路 1 号"), ("contact", None), ("phone", None))]))
    row = reconcile.reconcile(blank_record(base).drop("issues", "carriers")).first()
    assert row["ready_for_order"] is True and row["review_issues"] == []
    assert (row["customer"], row["carrier"], row["loading_time"]) == ("某客户", "ONE LINE", "2026-01-02T08:00:00")
    assert row["containers"][0]["mbl_no"] == "ONEY12345678" and row["order_mapping"]["mbl_no"] == "ONEY12345678"


def test_template_fingerprint_needs_the_exact_header(spark):
    good = "\n".join("| " + " | ".join(r) + " |" for r in D.TRANSPORT_HEADER_ROWS)
    assert one(spark, mapping.fingerprint(segments.table_rows(F.lit(good)))) == mapping.TRANSPORT_FINGERPRINT
    assert one(spark, mapping.fingerprint(segments.table_rows(F.lit(good.replace("码头", "港"))))) != mapping.TRANSPORT_FINGERPRINT


def test_overlap_by_centre_and_by_identical_boxes(spark):
    rows = [(1, 1, 0, "船名", 0.0, 100.0, 0.0, 10.0), (1, 1, 1, "件数", 10.0, 30.0, 1.0, 9.0),
            (2, 1, 0, "船名", 0.0, 10.0, 0.0, 10.0), (2, 1, 1, "件数", 8.0, 18.0, 0.0, 10.0), (3, 1, 0, "船名", 5.0, 9.0, 5.0, 9.0), (3, 1, 1, "船名", 5.0, 9.0, 5.0, 9.0)]
    boxes = spark.createDataFrame(rows, "doc_id long, page int, idx int, text string, x0 double, x1 double, top double, bottom double")
    assert {r["doc_id"]: r["bbox_overlap"] for r in pages.overlapping_pages(boxes).collect()} == {1: True, 2: False, 3: True}


def test_candidate_with_items_factory_and_issues(spark):
    entry = "doc_id long, pos int, key string, value string"
    nested = "doc_id long, idx int, pos int, key string, value string"
    top = spark.createDataFrame([(1, 0, "提单号", "ABCD12345678"), (1, 1, "件数", "7"), (2, 0, "mbl_no", "B"), (3, 0, "mbl_no", "C"),
                                 (4, 0, "箱型箱量", "2 x 40HQ")], entry)
    item_rows = spark.createDataFrame([(1, 0, 0, "type", "40'HQ"), (1, 0, 1, "qty", "1"), (1, 1, 0, "type", "20GP"), (1, 1, 1, "packages", "12 CTNS")], nested)
    factory_rows = spark.createDataFrame([(1, 0, "name", "Works"), (1, 1, "address", "Road 1")], entry)
    issue_rows = spark.createDataFrame(
        [(1, 1, k, key, value) for k, (key, value) in enumerate((("code", "late"), ("field", "etd"), ("message", "m"), ("blocking", "no")))]
        + [(1, 0, k, key, value) for k, (key, value) in enumerate((("code", "odd"), ("field", "pol"), ("message", "n"), ("source_values", '["x","y"]')))]
        + [(2, 0, 0, "code", "broken"), (3, 0, 0, "code", "broken")], nested)
    repaired = spark.createDataFrame([(3, 0, k, key, "r") for k, key in enumerate(("code", "field", "message"))], nested)
    found = {r.doc_id: r for r in extract.candidate_records(top, item_rows, factory_rows, issue_rows, repaired).collect()}
    one_ = found[1]
    assert [(c["type"], c["qty"], c["packages"]) for c in one_.containers] == [("40HQ", 1, 7), ("20GP", None, 12)]
    assert one_.factory["name"] == "Works" and one_.factory["address"] == "Road 1" and one_.mbl_no == "ABCD12345678"
    assert [(i["code"], i["source_values"], i["blocking"]) for i in one_.review_issues] == [("odd", ["x", "y"], True), ("late", [], False)]
    assert found[2].record_error and found[3].record_error is None and codes(found[3], "review_issues") == ["r"]
    assert [(c["type"], c["qty"]) for c in found[4].containers] == [("40HQ", 2)] and found[2].containers == []
    docs = spark.createDataFrame([(k, "a.pdf", "text") for k in (1, 2, 9)], "doc_id long, file string, text string")
    joined = {r.doc_id: r for r in extract.working_records(docs, extract.candidate_records(top, item_rows, factory_rows, issue_rows, repaired)).collect()}
    assert joined[9].record_error == "no_candidate" and joined[1].record_error is None and joined[2].record_error and len(joined) == 3


def test_entities(spark):
    import html

    for text in ("&mdash;&#20214;&#x4E2D;&#128;&amp;lt;", "&notit; &bogus; & &#0; &#xD800; &#1114112;", "a&nbsp;b&copy", "&#99999999999;"):
        assert one(spark, unescape_entities(F.lit(text))) == html.unescape(text)


def test_reply_search_has_no_depth(spark):
    deep = '{"markdown": 7, "a": ' * 60 + '{"markdown": " text "}' + "}" * 60
    frame = spark.createDataFrame([(1, deep), (2, "no json"), (3, None), (4, '{"markdown": {"markdown": "inner"}}'), (5, "[" * 5000)], "doc_id long, payload string")
    assert {r.doc_id: r.value for r in pages.payload_markdown(frame).collect()} == {1: " text ", 4: "inner"}
