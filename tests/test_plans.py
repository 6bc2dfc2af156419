"""Physical plans and results of the registered queries."""

import os
import re

import pytest

import __spark_entry__ as driver
from daybook.plans.check_sql import statements
from daybook.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables absent")

STORING = {
    "csv_round_trip", "scan_events_partitioned", "read_flat_log", "write_table", "publish_table",
    "catalog_partitioned", "catalog_repair", "catalog_external", "catalog_partitions", "catalog_tables",
    "csv_all_tables", "replace_table", "table_versions", "ordered_table",
    "incremental_build",
}
UNWANTED = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
    "InPandas", "PythonUDF",
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STORING))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not [word for word in UNWANTED if word in text]


def test_every_query_has_sql():
    assert set(statements()) == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(QUERIES) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1


def test_user_is_broadcast(spark):
    text = plan(QUERIES["dws_channel_region_summary"](spark, FOLDER))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_scans_read_only_what_is_used(spark):
    text = plan(QUERIES["dws_event_type_summary_1d"](spark, FOLDER))
    assert "struct<ts:timestamp_ntz,event_type:string>" in re.findall(r"ReadSchema: (struct<[^ ]*>)", text)
    assert "props" not in text and "o_totalprice" not in text
    text = plan(QUERIES["task_funnel"](spark, FOLDER))
    assert "props" not in text and "l_quantity" not in text


def test_sessions_shuffle_slots_not_events_for_the_window(spark):
    """The window that numbers sessions runs over one row per user and slot."""
    text = plan(QUERIES["sessionize"](spark, FOLDER))
    window = text.index("Window [")
    assert "HashAggregate" in text[window:]


@pytest.mark.parametrize(
    "name, scans",
    # The parts of the log are orders, orders again for the owners of lines, lines and events.
    [("dws_user_active_1d", 8 + 3), ("duplicate_sessions", 16), ("event_transitions", 2)],
)
def test_the_log_is_not_scanned_for_every_count(spark, name, scans):
    """Scans as planned, before any are reused: sessions and events once each."""
    text = plan(QUERIES[name](spark, FOLDER))
    assert text.count("FileScan parquet") <= scans


@pytest.mark.parametrize(
    "name", [
        "sessionize", "wau_mau", "wau_mau_bitmaps", "dws_user_active_1d", "dwd_task_lifecycle",
        "dws_user_feature_usage_summary", "duplicate_sessions", "missing_days", "ordered_funnel",
    ],
)
def test_results_equal_the_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.compare import compare, connect

    assert duckdb
    con = connect(FOLDER)
    assert compare(spark, con, FOLDER, name, QUERIES[name], statements()[name]) is None
