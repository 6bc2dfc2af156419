"""The registered queries: every operator over the sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daybook import schemas
from daybook.functions.lookups import lookup_join
from daybook.functions.values import lenient_date
from daybook.operators import activity, bitmaps, derive, detail, features, lifecycle, quality, sequences, summary
from daybook.plans import layers
from daybook.session import scratch_path
from daybook.sources import catalog, files, versions
from daybook.sources import sample_tables as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Days that are holidays in the sample calendar.
HOLIDAYS = ("1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01")
# Days that are holidays where the ``events`` table alone is read.
EVENT_HOLIDAYS = ("2024-01-01", "2024-01-15", "2024-02-19")
# Day indexes in a row of the cohort matrix; the first row of a cohort has days 0 to 30.
MATRIX_BAND = 31
# Sessions that a frequent sequence occurs in, and event types in it.
SEQUENCE_SESSIONS, SEQUENCE_LENGTH = 5, 4


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round means of doubles, whose last bits depend on the order of addition."""
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- inputs -------------------------------------------------------------------


def _log(spark, folder):
    """Combined log, typed, without sessions."""
    return detail.typed_events(st.event_log(spark, folder))


def _session_log(spark, folder):
    """Combined log, typed, with sessions."""
    return detail.typed_events(st.todo_events(spark, folder))


def _event_raw(spark, folder):
    """Events with sessions, users and tasks."""
    return detail.event_raw(
        st.event_parts(spark, folder), st.dim_user(spark, folder), st.dim_task(spark, folder), gap_minutes=30
    )


def _lifecycle(spark, folder):
    return detail.task_lifecycle(_log(spark, folder), st.dim_task(spark, folder))


def _active_days(spark, folder):
    """User and day of the whole log, without the counts that need sessions."""
    day = F.to_date("event_time").alias("active_date")
    return _log(spark, folder).select("user_id", day).distinct()


def _active_1d(spark, folder):
    """Day and known user (NULL for all others) of the whole log."""
    known = st.dim_user(spark, folder).select("user_id", F.col("user_id").alias("known_user"))
    joined = lookup_join(_active_days(spark, folder), known, "user_id", spread=None)
    return joined.select(F.col("known_user").alias("user_id"), F.col("active_date").alias("stat_date"))


def _behavior(spark, folder):
    log = _log(spark, folder)
    return summary.user_behavior_summary(log, detail.task_lifecycle(log, st.dim_task(spark, folder)))


def _task_summary(spark, folder):
    return summary.task_summary_1d(_lifecycle(spark, folder))


def _channels(spark, folder):
    return summary.channel_region_summary(_log(spark, folder), st.dim_user(spark, folder))


def _usage(spark, folder):
    log = _log(spark, folder)
    return summary.user_feature_usage_summary(
        log, detail.task_lifecycle(log, st.dim_task(spark, folder))
    )


def _retain(spark, folder):
    return summary.user_retain_summary(_active_days(spark, folder))


# --- sources, sinks, catalog --------------------------------------------------


def _partitioned_copy(spark, folder) -> tuple[str, StructType]:
    events = st.sample(spark, folder, "events")
    path = scratch_path(spark, "event_log")
    files.write_partitioned(
        events.withColumn("event_date", derive.event_date(F.col("ts"))), path
    )
    return path, st.SCHEMAS["events"]


@query
def scan_events(spark, folder):
    return st.sample(spark, folder, "events")


@query
def read_or_empty(spark, folder):
    schema = st.SCHEMAS["events"]
    found = files.read_or_empty(spark, f"{folder.rstrip('/')}/events.parquet", schema)
    return found.unionByName(files.read_or_empty(spark, f"{folder.rstrip('/')}/absent.parquet", schema))


@query
def scan_events_partitioned(spark, folder):
    path, schema = _partitioned_copy(spark, folder)
    return files.read_event_log(spark, path, "2024-01-08", "2024-01-14", schema)


@query
def read_flat_log(spark, folder):
    """A log stored without its day: the bounds work on the day of the event time."""
    path = scratch_path(spark, "flat_log")
    files.write_table(st.sample(spark, folder, "events").withColumnRenamed("ts", "event_time"), path)
    return files.read_event_log(spark, path, "2024-01-08", "2024-01-14", None)


@query
def write_table(spark, folder):
    path = scratch_path(spark, "orders")
    files.write_table(st.sample(spark, folder, "orders"), path)
    return files.read_table(spark, path, st.SCHEMAS["orders"])


@query
def publish_table(spark, folder):
    return files.publish(_task_summary(spark, folder), scratch_path(spark, "published"), "task_summary")


# Text that a CSV writer has to protect, put before and after a table's own text.
AWKWARD = (" ", "", "\n", "\r", '"', "\\", ",", "\\N")


@query
def csv_round_trip(spark, folder):
    """``events`` with awkward text around, or in place of, its own."""
    texts = F.array(*[F.lit(text) for text in AWKWARD])
    chosen = texts[(F.col("event_id") % len(AWKWARD)).cast("int")]
    events = st.sample(spark, folder, "events").withColumn(
        "props",
        F.when(F.col("event_id") % 5 == 0, F.lit(None))
        .when(F.col("event_id") % 7 == 0, F.lit(""))
        .otherwise(F.concat(chosen, "props", chosen)),
    )
    path = scratch_path(spark, "events_csv")
    files.export_csv(events, path)
    return files.read_csv(spark, path, events.schema)


def _partitioned_table(spark, folder) -> str:
    path, schema = _partitioned_copy(spark, folder)
    database = f"daybook_{uuid.uuid4().hex[:12]}"
    current = spark.catalog.currentDatabase()
    catalog.ensure_database(spark, database, scratch_path(spark, database))
    try:
        catalog.drop_tables(spark, "ods_todo_event_log")
        catalog.create_partitioned_table(spark, "ods_todo_event_log", schema, path)
        catalog.repair_partitions(spark, "ods_todo_event_log")
    finally:
        spark.catalog.setCurrentDatabase(current)
    return f"{database}.ods_todo_event_log"


@query
def catalog_partitioned(spark, folder):
    return spark.table(_partitioned_table(spark, folder))


@query
def catalog_external(spark, folder):
    """``orders`` stored, and read as an external table."""
    path = scratch_path(spark, "orders")
    files.write_table(st.sample(spark, folder, "orders"), path)
    database, current = f"daybook_{uuid.uuid4().hex[:12]}", spark.catalog.currentDatabase()
    catalog.ensure_database(spark, database, scratch_path(spark, database))
    try:
        catalog.create_external_table(spark, "orders", st.SCHEMAS["orders"], path)
    finally:
        spark.catalog.setCurrentDatabase(current)
    return spark.table(f"{database}.orders")


@query
def catalog_tables(spark, folder):
    """The tables of a database, listed by the catalog, and their rows."""
    database, current = f"daybook_{uuid.uuid4().hex[:12]}", spark.catalog.currentDatabase()
    catalog.ensure_database(spark, database, scratch_path(spark, database))
    try:
        for name, schema in st.SCHEMAS.items():
            catalog.create_external_table(spark, name, schema, f"{folder.rstrip('/')}/{name}.parquet")
    finally:
        spark.catalog.setCurrentDatabase(current)
    names = [r.tableName for r in catalog.list_tables(spark, database).filter("NOT isTemporary").collect()]
    return quality.row_counts({name: spark.table(f"{database}.{name}") for name in names})


@query
def csv_all_tables(spark, folder):
    """All sample tables written as CSV and read back: rows, and columns with a value."""
    tables = {name: st.sample(spark, folder, name) for name in st.SCHEMAS}
    path = scratch_path(spark, "csv")
    files.export_tables_csv(tables, path)
    back = {name: files.read_csv(spark, f"{path}/{name}", schema) for name, schema in st.SCHEMAS.items()}
    return quality.row_counts(back)


def _replaced(spark, folder) -> str:
    """A table of orders that was replaced twice, with other rows, columns and partitions."""
    database, current = f"daybook_{uuid.uuid4().hex[:12]}", spark.catalog.currentDatabase()
    catalog.ensure_database(spark, database, scratch_path(spark, database))
    spark.catalog.setCurrentDatabase(current)
    name, orders = f"{database}.orders_now", st.sample(spark, folder, "orders")
    versions.replace_table(orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), name, keep=3)
    versions.replace_table(orders, name, partition=["o_orderstatus"], keep=3)
    price = F.when(F.col("o_totalprice") < 100000, "low").otherwise("high")
    versions.replace_table(spark.table(name).withColumn("price_class", price), name, keep=3)
    return name


@query
def replace_table(spark, folder):
    return spark.table(_replaced(spark, folder))


@query
def table_versions(spark, folder):
    """The versions behind the name after going back to the second one."""
    name = _replaced(spark, folder)
    versions.restore_version(spark, name, 2)
    return versions.list_versions(spark, name)


@query
def ordered_table(spark, folder):
    """Hourly activity, stored in the order of day and hour."""
    hours = summary.hour_active_summary(_log(spark, folder))
    return files.publish_ordered(hours, scratch_path(spark, "ordered"), "hours", ["stat_date", "active_hour"])


@query
def catalog_partitions(spark, folder):
    return catalog.list_partitions(spark, _partitioned_table(spark, folder))


@query
def publish_views(spark, folder):
    name = f"orders_{uuid.uuid4().hex[:12]}"
    catalog.publish_views({name: st.sample(spark, folder, "orders")})
    return spark.sql(f"SELECT o_orderpriority, count(*) AS cnt FROM {name} GROUP BY o_orderpriority")


@query
def catalog_repair(spark, folder):
    table = spark.table(_partitioned_table(spark, folder))
    return table.groupBy("event_date").agg(F.count(F.lit(1)).alias("row_count"))


@query
def preview_limit(spark, folder):
    return files.preview(st.sample(spark, folder, "events"), 10, ("ts", "event_id"))


@query
def dim_user(spark, folder):
    return st.dim_user(spark, folder)


@query
def dim_task(spark, folder):
    return st.dim_task(spark, folder)


# --- detail layer ---------------------------------------------------------------


@query
def event_raw(spark, folder):
    return _event_raw(spark, folder)


@query
def event_clean(spark, folder):
    return detail.event_clean(_event_raw(spark, folder))


@query
def dwd_todo_event_detail(spark, folder):
    return detail.event_detail(detail.event_clean(_event_raw(spark, folder)))


@query
def dwd_task_lifecycle(spark, folder):
    return _lifecycle(spark, folder)


@query
def dwd_user_active_detail(spark, folder):
    return detail.user_active_detail(_session_log(spark, folder))


# First day that the second of two builds adds.
ADDED_FROM = "2024-01-20"


@query
def incremental_build(spark, folder):
    """Joined app events of two builds: the first of the days before ``ADDED_FROM``, with
    users that have moved since, the second of the days added and what has changed."""
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "out")
    log = st.app_events(spark, folder).withColumn("session_id", F.lit(None).cast("string"))
    log = log.select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.EVENT_LOG],
        F.to_date("event_time").cast("string").alias("event_date"),
    )
    users, path = st.dim_user(spark, folder), f"{raw}/ods_todo_event_log"
    moved = F.when(F.col("user_id") % 10 == 0, "elsewhere").otherwise(F.col("province"))
    added = F.col("event_date") >= ADDED_FROM
    files.write_table(schemas.conform(st.dim_task(spark, folder), schemas.DIM_TASK), f"{raw}/dim_task")
    for number, (dim, part) in enumerate(((users.withColumn("province", moved), ~added), (users, added))):
        files.write_table(schemas.conform(dim, schemas.DIM_USER), f"{raw}/dim_user")
        files.write_partitioned(log.filter(part), path)
        days = (ADDED_FROM, "9999-12-31") if number else None
        stored, manifest, changes = layers.store_detail(spark, layers.read_raw(spark, raw), raw, out, days=days)
        manifest.store(changes)
    return stored["event_raw"].select(
        "event_id", "user_id", "event_time", "event_type", "province", "register_channel"
    )


# --- summary layer --------------------------------------------------------------


@query
def dws_user_active_1d(spark, folder):
    return summary.user_active_1d(_session_log(spark, folder), st.dim_user(spark, folder))


@query
def dws_user_behavior_summary(spark, folder):
    return _behavior(spark, folder)


@query
def dws_task_summary_1d(spark, folder):
    return _task_summary(spark, folder)


@query
def dws_event_type_summary_1d(spark, folder):
    return summary.event_type_summary_1d(_log(spark, folder))


@query
def dws_hour_active_summary(spark, folder):
    return summary.hour_active_summary(_log(spark, folder))


@query
def dws_channel_region_summary(spark, folder):
    return _channels(spark, folder)


@query
def channel_region_rollup(spark, folder):
    return summary.channel_region_rollup(_log(spark, folder), st.dim_user(spark, folder))


@query
def dws_new_old_user_summary(spark, folder):
    return summary.new_old_user_summary(_active_days(spark, folder))


@query
def dws_user_retain_summary(spark, folder):
    return _retain(spark, folder)


@query
def dws_user_feature_usage_summary(spark, folder):
    return _usage(spark, folder)


@query
def feature_usage_by_task(spark, folder):
    """The feature usage table with each event counted once."""
    return summary.user_feature_usage_summary(
        _log(spark, folder), st.dim_task(spark, folder), dedupe_task=True
    )


# --- activity -------------------------------------------------------------------


@query
def dau(spark, folder):
    return activity.dau(_active_1d(spark, folder))


@query
def dau_filled(spark, folder):
    return activity.dau_filled(_active_1d(spark, folder))


@query
def wau_mau(spark, folder):
    return activity.activity_trend(_active_1d(spark, folder))


def _bitmaps(spark, folder) -> DataFrame:
    """Stored bitmaps of the active users of each day."""
    active, path = _active_1d(spark, folder), scratch_path(spark, "bitmaps")
    numbers = files.publish(bitmaps.number_users(active), path, "numbers")
    numbered = lookup_join(active, numbers, "user_id", spread="stat_date")
    return files.publish(bitmaps.daily_bitmaps(numbered), path, "daily")


@query
def wau_mau_bitmaps(spark, folder):
    """The trend from stored bitmaps alone, with a window of 90 days more."""
    return bitmaps.trailing_users(_bitmaps(spark, folder), {"wau": 7, "mau": 30, "qau": 90})


@query
def monthly_users(spark, folder):
    """Users of each month, and those of the month before among them."""
    month = (F.year("date") * 12 + F.month("date")).cast("bigint")
    return bitmaps.kept_users(_bitmaps(spark, folder), month, "month_no")


def _log_calendar(spark, folder, holidays=HOLIDAYS):
    return derive.date_dim(derive.day_bounds(_log(spark, folder), "event_time"), holidays)


@query
def activity_by_day_kind(spark, folder):
    """Users, events and completions on workdays, weekends and holidays."""
    completed = F.count(F.when(F.col("event_type") == "complete_task", F.lit(1)))
    daily = _log(spark, folder).groupBy(F.to_date("event_time").alias("date")).agg(
        F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"), completed.alias("completed")
    )
    measures = ("users", "events", "completed")
    kinds = activity.activity_by_day_kind(daily, _log_calendar(spark, folder), measures)
    return rounded(kinds, *[f"{m}_per_day" for m in measures])


@query
def weekend_events(spark, folder):
    """Weekend events of a day-partitioned log; the calendar prunes the scan."""
    path, schema = _partitioned_copy(spark, folder)
    calendar = derive.date_dim(derive.day_bounds(st.sample(spark, folder, "events"), "ts"), EVENT_HOLIDAYS)
    return activity.of_day_kind(files.read_event_log(spark, path, schema=schema), calendar, "weekend")


@query
def activity_kpis(spark, folder):
    return activity.activity_kpis(activity.activity_trend(_active_1d(spark, folder)))


@query
def new_old_structure(spark, folder):
    return activity.new_old_structure(dws_new_old_user_summary(spark, folder))


@query
def new_old_share(spark, folder):
    return activity.new_old_share(dws_new_old_user_summary(spark, folder))


@query
def activity_frequency(spark, folder):
    return activity.activity_frequency(_behavior(spark, folder))


@query
def active_share(spark, folder):
    return activity.active_share(_behavior(spark, folder))


@query
def active_share_of_all(spark, folder):
    """Users with an event in the log against all users."""
    return activity.active_share(_behavior(spark, folder), st.dim_user(spark, folder))


@query
def retention_rates(spark, folder):
    return activity.retention_rates(_retain(spark, folder))


@query
def retention_long(spark, folder):
    return activity.retention_long(activity.retention_rates(_retain(spark, folder)))


@query
def retention_censored(spark, folder):
    """Retention counts, unknown (NULL) where the day lies after the data."""
    return summary.user_retain_summary(_active_days(spark, folder), censor=True)


@query
def retention_curve(spark, folder):
    """Every day index of every cohort, as the long table a wide matrix is cut from."""
    return activity.retention_curve(_active_days(spark, folder))


@query
def cohort_retention_matrix(spark, folder):
    """The whole matrix, a row for each cohort and 31 days of it."""
    return activity.cohort_bands(activity.retention_curve(_active_days(spark, folder)), MATRIX_BAND)


@query
def channel_totals(spark, folder):
    return activity.channel_totals(_channels(spark, folder))


@query
def channel_region_totals(spark, folder):
    return activity.channel_region_totals(_channels(spark, folder))


@query
def channel_quality(spark, folder):
    users = st.dim_user(spark, folder).select("user_id", F.col("register_channel").alias("channel"))
    active = _active_days(spark, folder).join(users, "user_id")
    cohorts = activity.retention_rates(summary.user_retain_summary(active, by=["channel"]))
    return rounded(activity.channel_quality(_channels(spark, folder), cohorts), "retain_7d")


# --- task lifecycle -------------------------------------------------------------


@query
def completion_kpis(spark, folder):
    return rounded(lifecycle.completion_kpis(_task_summary(spark, folder)), "avg_completion_rate")


@query
def completion_trend(spark, folder):
    return lifecycle.completion_trend(_task_summary(spark, folder))


@query
def completion_overall(spark, folder):
    return lifecycle.completion_overall(_task_summary(spark, folder))


@query
def priority_stats(spark, folder):
    return lifecycle.priority_stats(_lifecycle(spark, folder))


@query
def priority_long(spark, folder):
    return lifecycle.priority_long(lifecycle.priority_stats(_lifecycle(spark, folder)))


@query
def duration_box_sketch(spark, folder):
    """Quartiles from stored sketches of each day: whether their ranks are within 3 %."""
    cycle = _lifecycle(spark, folder)
    sketches = files.publish(lifecycle.duration_sketches(cycle), scratch_path(spark, "sketches"), "daily")
    errors = lifecycle.rank_errors(lifecycle.sketched_box(sketches), cycle)
    return errors.select("priority", "quantile", "n", (F.col("rank_error") <= 0.03).alias("within"))


@query
def ordered_funnel(spark, folder):
    return lifecycle.ordered_funnel(_log(spark, folder), within_days=60)


@query
def duration_histogram(spark, folder):
    return lifecycle.duration_histogram(_lifecycle(spark, folder))


@query
def duration_box(spark, folder):
    return lifecycle.duration_box_by_priority(_lifecycle(spark, folder))


@query
def task_funnel(spark, folder):
    return lifecycle.task_funnel(_log(spark, folder))


# --- feature usage --------------------------------------------------------------


def _flags(spark, folder):
    return features.feature_flags(_lifecycle(spark, folder))


@query
def feature_trend(spark, folder):
    return features.feature_trend(_usage(spark, folder))


@query
def latest_feature_kpi(spark, folder):
    return features.latest_feature_kpi(_usage(spark, folder))


@query
def feature_flags(spark, folder):
    return _flags(spark, folder).select(
        "task_id", "user_id", "has_reminder", "has_subtask", "has_due_date"
    )


@query
def completion_by_feature(spark, folder):
    return features.completion_by_feature(_flags(spark, folder))


@query
def user_feature_rates(spark, folder):
    return features.user_feature_rates(_flags(spark, folder))


def _segment_summary(spark, folder, segment):
    rates = features.user_feature_rates(_flags(spark, folder))
    return rounded(
        features.segment_feature_summary(
            rates, st.dim_user(spark, folder), _behavior(spark, folder), segment
        ),
        *features.USER_RATES,
        "completion_rate",
    )


@query
def segment_feature_summary(spark, folder):
    return _segment_summary(spark, folder, "user_group")


@query
def segment_feature_by_level(spark, folder):
    return _segment_summary(spark, folder, "user_level")


@query
def segment_feature_by_type(spark, folder):
    return _segment_summary(spark, folder, "user_type")


@query
def segment_feature_long(spark, folder):
    return features.segment_feature_long(segment_feature_summary(spark, folder))


@query
def segment_feature_matrix(spark, folder):
    return features.segment_feature_matrix(segment_feature_long(spark, folder))


# --- derivations ----------------------------------------------------------------


@query
def sessionize(spark, folder):
    events = _session_log(spark, folder)
    return events.select(
        "event_id", "user_id", "event_time", "session_id",
        derive.event_date(F.col("event_time")).alias("event_date"),
    )


@query
def dim_date(spark, folder):
    bounds = derive.day_bounds(st.sample(spark, folder, "orders"), "o_orderdate")
    return derive.date_dim(bounds, HOLIDAYS)


def _milestones(spark, folder):
    task = st.dim_task(spark, folder)
    deleted = F.col("create_time") + F.expr("INTERVAL '5' DAY")
    return derive.milestone_events(task.withColumn("delete_time", deleted))


@query
def milestone_events(spark, folder):
    return _milestones(spark, folder).select(
        "user_id", "task_id", "list_id", "event_type", "event_time"
    )


@query
def pack_attributes(spark, folder):
    events = _milestones(spark, folder).withColumn("action_duration", F.col("task_id") % 60)
    return derive.pack_attributes(events).select("task_id", "event_type", "attributes")


@query
def postponed_tasks(spark, folder):
    return derive.postponed_tasks(_event_raw(spark, folder))


@query
def event_transitions(spark, folder):
    return derive.event_transitions(_session_log(spark, folder), by=["user_id"])


@query
def frequent_sequences(spark, folder):
    """Event types that follow each other in many sessions."""
    events = _session_log(spark, folder)
    return sequences.frequent_sequences(events, SEQUENCE_SESSIONS, SEQUENCE_LENGTH, by=["user_id"])


@query
def parse_dates(spark, folder):
    """Order days written as ISO text, compact text and junk, read back."""
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyyMMdd"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd"))
        .otherwise("bad")
    )
    written = st.sample(spark, folder, "orders").select(text.alias("day_text"))
    return (
        written.select(lenient_date(written, "day_text").alias("day"))
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


# --- quality --------------------------------------------------------------------


@query
def row_counts(spark, folder):
    return quality.row_counts(
        {
            "dim_user": st.dim_user(spark, folder),
            "dim_date": dim_date(spark, folder),
            "dim_task": st.dim_task(spark, folder),
            "ods_todo_event_log": st.event_log(spark, folder),
        }
    )


@query
def require_row_count(spark, folder):
    """Lines, once they are found to be one to seven for each order."""
    orders, lines = st.sample(spark, folder, "orders"), st.sample(spark, folder, "lineitem")
    number = orders.count()
    checked = quality.require_row_count(lines, number, 7 * number, "lineitem")
    return orders.agg(F.count(F.lit(1)).alias("order_cnt"), F.lit(checked).cast("bigint").alias("line_cnt"))


@query
def require_parts_within(spark, folder):
    """Events of the log left after tasks created and deleted."""
    log = st.event_log(spark, folder)
    left = quality.require_parts_within(
        log.count(), {"create": log.filter("event_type = 'create_task'"), "delete": log.filter("event_type = 'delete_task'")}
    )
    return log.agg(F.count(F.lit(1)).alias("total"), F.lit(left).cast("bigint").alias("left_cnt"))


@query
def top_event_types(spark, folder):
    return quality.top_event_types(st.event_log(spark, folder))


@query
def duplicate_sessions(spark, folder):
    """Events of sessions with several rows, in one sessionization."""
    log = st.event_log(spark, folder).select("log_id", "user_id", "event_time", "event_type")
    repeated = derive.assign_sessions(log, spread="log_id", min_rows=2)
    return repeated.select(
        F.col("log_id").alias("event_id"), "user_id", "session_id", "event_time", "event_type"
    ).orderBy("session_id", "event_time")


@query
def duplicate_users(spark, folder):
    """Events of the app log whose user occurs more than once."""
    return quality.duplicates(st.app_events(spark, folder).select("log_id", "user_id"), "user_id", ["log_id"], spread="log_id")


@query
def schema_report(spark, folder):
    tables = {name: st.sample(spark, folder, name) for name in st.SCHEMAS}
    return quality.schema_report(tables, st.SCHEMAS)


@query
def run_metrics(spark, folder):
    return quality.run_metrics(
        st.dim_user(spark, folder), st.dim_task(spark, folder), _log(spark, folder)
    )


@query
def event_type_distribution(spark, folder):
    return quality.event_type_distribution(st.event_log(spark, folder))


@query
def null_ratios(spark, folder):
    columns = ["task_id", "create_time", "first_complete_time", "complete_duration_seconds", "due_date"]
    return quality.null_ratios(_lifecycle(spark, folder), columns)


@query
def value_counts(spark, folder):
    return quality.value_counts(_lifecycle(spark, folder), "has_reminder")


@query
def orphan_events(spark, folder):
    """Events of users and tasks not in the dimensions, and events outside a period."""
    return quality.orphan_events(
        _log(spark, folder),
        st.dim_user(spark, folder),
        st.dim_task(spark, folder),
        F.lit("1995-06-01").cast("date"),
        F.lit("2001-06-30").cast("date"),
    )


@query
def missing_days(spark, folder):
    """Runs of days without an event, by event type and device."""
    return quality.missing_days(
        _log(spark, folder), ["event_type", "device_type"], _log_calendar(spark, folder), day="date_str"
    )


# Numeric columns, each with the column that groups it.
MEASURED = {
    "orders": {"o_totalprice": "o_orderpriority"},
    "lineitem": {
        "l_quantity": "l_returnflag", "l_extendedprice": "l_returnflag", "l_discount": "l_linestatus",
        "l_tax": "l_linestatus",
    },
    "events": {"value": "event_type"},
}


@query
def value_limits(spark, folder):
    """Median, deviation and limits of every numeric column by group."""
    frames = [
        quality.value_limits(st.sample(spark, folder, table), group, value)
        .withColumnRenamed(group, "group_value")
        .withColumn("column_name", F.lit(value))
        for table, columns in MEASURED.items()
        for value, group in columns.items()
    ]
    return reduce(DataFrame.unionByName, frames)


@query
def unreasonable_events(spark, folder):
    """Events whose value is far from what is usual for their type."""
    events = st.sample(spark, folder, "events")
    limits = quality.value_limits(events, "event_type", "value")
    return quality.beyond_limits(events, limits, "event_type", "value")
