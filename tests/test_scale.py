"""What keeps the cost of a document and of a task small: plans and sizes, next to the results they must not change."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from freightdocs.functions import text as t
from freightdocs.functions import values as v
from freightdocs.operators import grids, mapping, orders
from freightdocs.operators import segments as seg
from freightdocs.plans.registry import QUERIES
from freightdocs.sources import corpus


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blanks_are_trimmed_without_a_pattern(spark):
    df = spark.createDataFrame([Row(x=f"{c}　a{c}b \x1f{c}") for c in t.BLANKS] + [Row(x="　 "), Row(x=None)], "x string")
    got = df.select(t.strip(F.col("x")).alias("s"), t.is_blank(F.col("x")).alias("b"))
    assert "regexp" not in plan(got).lower() and "rlike" not in plan(got).lower()
    rows = got.collect()
    assert [r.s for r in rows] == [f"a{c}b" for c in t.BLANKS] + ["", None]
    assert [r.b for r in rows] == [False] * len(t.BLANKS) + [True, True]


def test_lines_and_cells_of_all_kinds_of_breaks_and_escapes(spark):
    texts = ["a\r\r\nb c\n", "\n", "", "|a\\|b|c||", "|x|y"]
    df = spark.createDataFrame([Row(x=x) for x in texts], "x string")
    rows = df.select(t.split_lines(F.col("x")).alias("l"), seg.pipe_cells(F.col("x")).alias("c")).collect()
    assert [r.l for r in rows[:3]] == [["a", "", "b", "c"], [""], []]
    assert [r.c for r in rows[3:]] == [["a|b", "c"], ["x", "y"]]


def test_booking_cells_are_keyed_once_for_all_labels(spark):
    df = spark.createDataFrame([Row(rows=[["船 公 司：", "COSCO", "船期", "承运人"], ["", "", "ETD1", "x"]])], "rows array<array<string>>")
    got = df.select(mapping.booking_values(F.col("rows")).alias("x"))
    assert plan(got).count("lower(") == 1
    assert got.first().x.carrier == "COSCO"


def test_a_date_tries_no_cast_on_an_absent_clock(spark):
    df = spark.createDataFrame([Row(x="于 2024/2/3 前"), Row(x="2024-2-3 9:05"), Row(x="2024-2-3 9：05：70"), Row(x="no"), Row(x="2023-02-30"), Row(x=None)], "x string")
    got = df.select(v.parse_date(F.col("x"), allow_time=True).alias("p"), v.whole_date(F.col("x"), allow_time=True).alias("w"))
    assert [tuple(r) for r in got.collect()] == [
        ("2024-02-03", None), ("2024-02-03T09:05:00",) * 2, (None, None), (None, None), (None, None), (None, None)]
    assert "split(" not in plan(got)  # a split compiles its pattern for every value


def test_a_task_gets_a_bounded_number_of_orders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "ORDERS_A_TASK", 3)
    spark.range(100).selectExpr("id AS o_orderkey", "id % 2 AS o_custkey", "date'2024-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(2).selectExpr("id AS c_custkey", "'c' AS c_name", "id AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2).selectExpr("id AS n_nationkey", "'n' AS n_name", "id AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(2).selectExpr("id AS r_regionkey", "'r' AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    df = corpus.facts(spark, str(tmp_path), with_lines=False)
    assert df.rdd.getNumPartitions() >= 34 and df.count() == 100


def test_section_headings_need_no_shuffle_of_their_own(spark):
    rows = [(1, "story", 0, "h", 1, "a"), (1, "story", 0, "h", 2, "b"), (1, "story", 0, "g", 1, "c"), (2, "image", 0, "d", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, kind string, part_no int, part string, n int, text string").withColumns(
        {"file": F.lit("f"), "relation": F.lit("r")}).repartition(4, "doc_id")
    got = grids.section_lines(df)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    heads = got.filter("at.n = 0 AND k = 0").select("doc_id", "line").collect()
    assert sorted(map(tuple, heads)) == [(1, "## Story: g"), (1, "## Story: h"), (2, "## Embedded images")]
    assert got.count() == 2 * 3 + 2 * 3 + 3


def test_order_labels_are_looked_up_once_and_pairs_need_no_pattern_of_their_own(spark):
    texts = ["提单号：A；托运人:T\n备注：；：x；公司名称： B：C 　；提单号:Z;主单号：M", " : v;no pair", "a" * 50_000, "", None]
    df = spark.createDataFrame([Row(x=x) for x in texts], "x string")
    got = df.select(seg.label_values(F.col("x")).alias("p")).select("p", orders.field_values(F.col("p")).alias("f"))
    text = plan(got)
    assert text.count("lower(") == 1 and text.count("regexp_extract(") == 0
    rows = got.collect()
    assert [tuple(p) for p in rows[0].p] == [("提单号", "Z"), ("托运人", "T"), ("公司名称", "B：C"), ("主单号", "M")]
    assert (rows[0].f.order_num1, rows[0].f.c_title, rows[0].f.c_note) == ("M", "B：C", None)
    assert [tuple(p) for p in rows[1].p] == [(" ", "v")]
    assert [r.p for r in rows[2:]] == [[], [], None] and rows[4].f.order_num1 is None


def test_box_places_are_added_up_without_a_growing_list(spark):
    df = spark.createDataFrame([Row(x="20GP x 3+ 4*20GP，２ × 40HQ 0*45HC"), Row(x="12*20GP*30"), Row(x=""), Row(x=None)], "x string")
    got = df.select(orders.boxes(F.col("x")).alias("b"))
    assert "concat(" not in plan(got)
    assert [[tuple(b) for b in r.b] for r in got.collect()] == [[("20GP", 7), ("40HQ", 2)], [("20GP", 42)], [], []]


def test_both_sides_of_the_gate_read_texts_that_are_parsed_once(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "提单号：A；托运人：T", "r"), (2, "提单号：A", "r"), (3, None, "r")], "doc_id long, content string, roomId string")
    monkeypatch.setattr(corpus, "order_texts", lambda spark, sf: texts)
    got = QUERIES["ord_5_readiness_gate"](spark, "")
    assert "regexp" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, True, ""), (2, False, "c_title"), (3, False, "order_num1|c_title")]
