"""Sample star-schema tables read as the contract tables.

customer+nation+region stand for users, orders for tasks, and orders, lineitem
and events together for the event log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.lookups import lookup_join
from daybook.operators.derive import assign_sessions
from daybook.schemas import columns
from daybook.sources.files import read_table

SCHEMAS = {
    name: columns(text)
    for name, text in {
        "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
        "value DOUBLE, props STRING",
        "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
        "c_mktsegment STRING",
        "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
        "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
        "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
        "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
        "region": "r_regionkey INT, r_name STRING",
    }.items()
}


def sample(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder.rstrip('/')}/{name}.parquet", SCHEMAS[name])


def dim_user(spark: SparkSession, folder: str) -> DataFrame:
    # nation and region have 25 and 5 rows at every scale.
    places = sample(spark, folder, "nation").join(
        F.broadcast(sample(spark, folder, "region")), F.expr("n_regionkey = r_regionkey")
    )
    customer = sample(spark, folder, "customer")
    return customer.join(F.broadcast(places), F.expr("c_nationkey = n_nationkey")).selectExpr(
        "c_custkey AS user_id",
        "CAST(NULL AS STRING) AS register_time",
        "CASE WHEN c_acctbal < 5000 THEN 'lower' ELSE 'upper' END AS user_group",
        "CASE WHEN c_acctbal < 2500 THEN 'level_1' WHEN c_acctbal < 7500 THEN 'level_2' ELSE 'level_3' END"
        " AS user_level",
        "lower(c_mktsegment) AS user_type",
        "concat('gender_', c_custkey % 2) AS gender",
        "concat('ages_', c_custkey % 3) AS age_group",
        "r_name AS province",
        "n_name AS city",
        "c_acctbal >= 0 AS is_active",
        "c_mktsegment AS register_channel",
    )


LIST_ID = "o_custkey * 10 + o_orderkey % 5 AS list_id"


def dim_task(spark: SparkSession, folder: str) -> DataFrame:
    return sample(spark, folder, "orders").selectExpr(
        "o_orderkey AS task_id",
        "o_custkey AS user_id",
        LIST_ID,
        "CAST(NULL AS STRING) AS task_title",
        "o_orderpriority AS priority",
        "CASE WHEN o_totalprice < 200000"
        " THEN CAST(date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 31 AS INT)) AS STRING)"
        " END AS due_date",
        "o_orderdate AS create_time",
        "CASE WHEN o_orderstatus = 'F'"
        " THEN o_orderdate + make_dt_interval(0, CAST(o_orderkey % 72 AS INT)) END AS complete_time",
        "o_orderstatus = 'F' AS is_completed",
        "o_orderkey % 3 = 0 AS has_subtask",
        "o_orderkey % 2 = 0 AS has_reminder",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'deleted' END"
        " AS task_status",
    )


def _client(number: str) -> list[str]:
    return [
        f"concat('device_', {number} % 3) AS device_type",
        f"concat('os_', {number} % 4) AS os",
        f"concat('version_', {number} % 5) AS app_version",
        f"concat('network_', {number} % 2) AS network_type",
    ]


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """The combined log without sessions."""
    created, touched, app = event_parts(spark, folder)
    return created.unionByName(touched).unionByName(app)


def event_parts(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The parts of the combined log: tasks created, tasks touched, and app events."""
    orders = sample(spark, folder, "orders")
    created = orders.selectExpr(
        "concat('c', o_orderkey) AS log_id",
        "o_custkey AS user_id",
        "o_orderdate AS event_time",
        "'create_task' AS event_type",
        "o_orderkey AS task_id",
        LIST_ID,
        """concat('{"action_duration": ', o_orderkey % 60,"""
        """ ', "due_date": null, "has_reminder": true}') AS attributes""",
        *_client("o_orderkey"),
    )
    lines = sample(spark, folder, "lineitem")
    owner = orders.selectExpr("o_orderkey AS l_orderkey", "o_orderkey", "o_custkey")
    owned = lookup_join(lines, owner, "l_orderkey", spread=["l_partkey", "l_suppkey"])
    touched = owned.filter("o_orderkey IS NOT NULL").selectExpr(
        "concat('l', l_orderkey, '_', l_linenumber, '_', l_partkey) AS log_id",
        "CASE WHEN l_returnflag = 'A' THEN l_suppkey ELSE o_custkey END AS user_id",
        "l_shipdate AS event_time",
        "CASE l_returnflag WHEN 'N' THEN 'complete_task' WHEN 'R' THEN 'delete_task'"
        " ELSE 'edit_task' END AS event_type",
        "l_orderkey AS task_id",
        LIST_ID,
        """concat('{"action_duration": ', l_linenumber, ', "new_priority": "high"',"""
        """ CASE WHEN l_returnflag = 'A'"""
        """ THEN concat(', "new_due_date": "', CAST(l_shipdate AS DATE), '"') ELSE '' END,"""
        """ '}') AS attributes""",
        *_client("l_partkey"),
    )
    return [created, touched, app_events(spark, folder)]


def app_events(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the log without tasks: the ``events`` table alone."""
    return sample(spark, folder, "events").selectExpr(
        "concat('e', event_id) AS log_id",
        "user_id",
        "ts AS event_time",
        "event_type",
        "CAST(NULL AS BIGINT) AS task_id",
        "CAST(NULL AS BIGINT) AS list_id",
        "props AS attributes",
        *_client("event_id"),
    )


def todo_events(spark: SparkSession, folder: str) -> DataFrame:
    """The combined log with sessions."""
    return assign_sessions(event_log(spark, folder), spread="log_id")
