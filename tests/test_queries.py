"""Registered queries against their checks in DuckDB, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
CHECKED = ("seg_1_lines", "seg_4_table_rows", "lab_2_adjacent_values", "nrm_1_key_canonical", "nrm_6_dates", "rte_1_templates", "rte_9_locked_merge",
           "iss_1_append_merge", "iss_2_one_per_code", "iss_6_output_order", "rec_8_container_identifiers", "rec_20_missing_measures", "ord_6_payload",
           "log_1_search", "log_2_newest_page", "doc_1_formats", "doc_6_merged_ranges", "doc_12_label_overlap", "doc_18_assembly", "out_2_label_text",
           "evl_1_field_diff", "evl_1_tree_diff", "str_1_streaming_orders", "snk_1_log_append")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_check(spark, con, name):
    result = compare(spark, con, name, SF, entry.oracle_sql()[name])
    assert result.startswith("ok (") and "EMPTY" not in result, result


def test_every_inventory_row_has_a_query():
    ids = {"_".join(n.split("_")[:2]) for n in entry.queries()}
    counts = {"src": 5, "snk": 5, "doc": 24, "seg": 11, "lab": 11, "nrm": 15, "rte": 11, "rec": 23, "iss": 8, "ord": 7, "log": 8, "out": 3, "evl": 3, "str": 2}
    missing = [f"{k}_{i}" for k, n in counts.items() for i in range(1, n + 1) if f"{k}_{i}" not in ids]
    assert missing == []


@pytest.mark.parametrize("name", ("lab_2_adjacent_values", "ord_6_payload", "rec_18_grounding", "doc_11_page_quality", "rte_8_transport_layout"))
def test_no_python_worker_and_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_entry_has_ready_orders(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "roomId", "payload"] and df.limit(1).count() == 1
