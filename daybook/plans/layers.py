"""The layers as named frames, and the job that stores them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook import schemas
from daybook.functions.lookups import fits_broadcast, key_counts
from daybook.operators import activity, detail, features, lifecycle, quality, summary
from daybook.plans.incremental import Changes, Manifest
from daybook.session import size_shuffles
from daybook.sources import catalog, files, versions

Frames = dict[str, DataFrame]

# Summary tables that are read by ranges of days, and the order in which they are stored.
ORDER = {
    "dws_task_summary_1d": ("stat_date",),
    "dws_event_type_summary_1d": ("stat_date", "event_type"),
    "dws_hour_active_summary": ("stat_date", "active_hour"),
    "dws_channel_region_summary": ("stat_date", "register_channel", "province", "city"),
}

def read_raw(spark: SparkSession, folder: str) -> Frames:
    """The raw tables of ``folder``, one directory per table, log by day."""
    base = folder.rstrip("/")
    tables = {
        name: files.read_table(spark, f"{base}/{name}", schema, conform=True)
        for name, schema in schemas.TABLES.items()
        if name not in ("ods_todo_event_log", "dim_date")
    }
    tables["dim_date"] = files.read_or_empty(spark, f"{base}/dim_date", schemas.DIM_DATE)
    tables["ods_todo_event_log"] = files.read_event_log(spark, f"{base}/ods_todo_event_log")
    return tables


def detail_layer(raw: Mapping[str, DataFrame]) -> Frames:
    """Detail tables. Lifecycles and active days need no dimension of the event,
    so they are built from the typed log and not from the joined events."""
    log, user, task = raw["ods_todo_event_log"], raw["dim_user"], raw["dim_task"]
    events = detail.typed_events(log)
    joined = detail.event_raw(log, user, task)
    clean = detail.event_clean(joined)
    return {
        "event_raw": joined,
        "event_clean": clean,
        "dwd_todo_event_detail": detail.event_detail(clean),
        "dwd_task_lifecycle": detail.task_lifecycle(events, task),
        "dwd_user_active_detail": detail.user_active_detail(events),
    }


def summary_layer(raw: Mapping[str, DataFrame], details: Mapping[str, DataFrame]) -> Frames:
    user = raw["dim_user"]
    events = details["event_clean"]
    cycle, active = details["dwd_task_lifecycle"], details["dwd_user_active_detail"]
    return {
        "dws_user_active_1d": summary.user_active_1d(events, user),
        "dws_user_behavior_summary": summary.user_behavior_summary(events, cycle),
        "dws_task_summary_1d": summary.task_summary_1d(cycle),
        "dws_event_type_summary_1d": summary.event_type_summary_1d(events),
        "dws_hour_active_summary": summary.hour_active_summary(events),
        "dws_channel_region_summary": summary.channel_region_summary(events, user),
        "dws_new_old_user_summary": summary.new_old_user_summary(active),
        "dws_user_retain_summary": summary.user_retain_summary(active),
        "dws_user_feature_usage_summary": summary.user_feature_usage_summary(events, cycle),
    }


def metric_layer(
    raw: Mapping[str, DataFrame],
    details: Mapping[str, DataFrame],
    summaries: Mapping[str, DataFrame],
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> Frames:
    """What the activity, lifecycle and feature pages show, as tables.

    ``keep`` may store a metric and return the stored frame, which the metrics
    made from it then read.
    """
    user = raw["dim_user"]
    cycle, active = details["dwd_task_lifecycle"], details["dwd_user_active_detail"]
    behavior = summaries["dws_user_behavior_summary"]
    tasks = summaries["dws_task_summary_1d"]
    channels = summaries["dws_channel_region_summary"]
    usage = summaries["dws_user_feature_usage_summary"]
    new_old = summaries["dws_new_old_user_summary"]
    metrics: Frames = {}

    def add(name: str, df: DataFrame) -> DataFrame:
        metrics[name] = keep(df, name)
        return metrics[name]

    trend = add("activity_trend", activity.activity_trend(summaries["dws_user_active_1d"]))
    add("activity_kpis", activity.activity_kpis(trend))
    add("new_old_structure", activity.new_old_structure(new_old))
    add("new_old_share", activity.new_old_share(new_old))
    add("activity_frequency", activity.activity_frequency(behavior))
    add("active_share", activity.active_share(behavior))
    rates = add(
        "retention_rates", activity.retention_rates(summaries["dws_user_retain_summary"])
    )
    add("retention_long", activity.retention_long(rates))
    add("cohort_matrix", activity.cohort_matrix(activity.retention_curve(active)))
    add("channel_totals", activity.channel_totals(channels))
    add("channel_region_totals", activity.channel_region_totals(channels))
    users = user.select("user_id", F.col("register_channel").alias("channel"))
    cohorts = summary.user_retain_summary(active.join(users, "user_id"), by=["channel"])
    add("channel_quality", activity.channel_quality(channels, activity.retention_rates(cohorts)))

    add("completion_kpis", lifecycle.completion_kpis(tasks))
    add("completion_trend", lifecycle.completion_trend(tasks))
    add("completion_overall", lifecycle.completion_overall(tasks))
    priorities = add("priority_stats", lifecycle.priority_stats(cycle))
    add("priority_long", lifecycle.priority_long(priorities))
    add("duration_histogram", lifecycle.duration_histogram(cycle))
    add("duration_box", lifecycle.duration_box_by_priority(cycle))
    add("task_funnel", lifecycle.task_funnel(details["event_clean"]))

    add("feature_trend", features.feature_trend(usage))
    add("latest_feature_kpi", features.latest_feature_kpi(usage))
    flags = features.feature_flags(cycle)
    add("completion_by_feature", features.completion_by_feature(flags))
    segments = add(
        "segment_feature_summary",
        features.segment_feature_summary(features.user_feature_rates(flags), user, behavior),
    )
    long = add("segment_feature_long", features.segment_feature_long(segments))
    add("segment_feature_matrix", features.segment_feature_matrix(long))
    return metrics


def _lifecycle_days(events: DataFrame) -> DataFrame:
    return detail.lifecycle_stats(events, by=("event_date",))


def _store_days(log: DataFrame, user: DataFrame, task: DataFrame, out: str, keep_others: bool) -> None:
    """The tables that are stored by event day, from the raw events of the days to make."""
    joined = detail.event_raw(log, user, task)
    # Where both dimensions are broadcast, tasks keep the days of the raw log.
    shuffled = not (fits_broadcast(user) and fits_broadcast(task))
    files.publish(
        joined, f"{out}/detail", "event_raw", "event_date", rebalance=shuffled, keep_others=keep_others
    )
    events = detail.typed_events(log)
    files.publish(_lifecycle_days(events), f"{out}/detail", "lifecycle_days", "event_date", keep_others=keep_others)
    files.publish(
        detail.user_active_detail(events), f"{out}/detail", "dwd_user_active_detail", "active_date",
        keep_others=keep_others, order=["user_id"],
    )


def store_detail(
    spark: SparkSession,
    raw: Frames,
    raw_folder: str,
    out: str,
    copies: bool = False,
    days: tuple[str, str] | None = None,
) -> tuple[Frames, Manifest | None, Changes | None]:
    """Build and store the detail layer, as ``run`` does. When all that is made of it is
    stored as well, ``manifest.store(changes)`` writes down what was read."""
    log, user, task = raw["ods_todo_event_log"], raw["dim_user"], raw["dim_task"]
    log_path = f"{raw_folder.rstrip('/')}/ods_todo_event_log"
    # A log without directories by day has no parts to leave unread.
    by_day = schemas.EVENT_PARTITION in spark.read.parquet(log_path).columns
    manifest = Manifest(spark, f"{out}/manifest", raw, log_path) if by_day else None
    changes = manifest.changes(days) if days is not None and by_day else None
    if changes is not None:
        log = changes.filter(log)
    if changes is None or changes.days:
        _store_days(log, user, task, out, changes is not None)

    joined = detail.event_raw(log, user, task)
    stored: Frames = {"event_raw": files.read_published(joined, f"{out}/detail", "event_raw", "event_date")}
    clean = detail.event_clean(stored["event_raw"])
    views = {"event_clean": clean, "dwd_todo_event_detail": detail.event_detail(clean)}
    for name, view in views.items():
        stored[name] = (
            files.publish(
                view, f"{out}/detail", name, "event_date", rebalance=False, keep_others=False
            )
            if copies
            else view
        )
    events = detail.typed_events(log)
    parts = files.read_published(_lifecycle_days(events), f"{out}/detail", "lifecycle_days", "event_date")
    cycle = detail.lifecycle_of(detail.merged_stats(parts), task, key_counts(parts, "task_id"))
    stored["dwd_task_lifecycle"] = files.publish(cycle, f"{out}/detail", "dwd_task_lifecycle")
    stored["dwd_user_active_detail"] = files.read_published(
        detail.user_active_detail(events), f"{out}/detail", "dwd_user_active_detail", "active_date"
    )
    return stored, manifest, changes


def run(
    spark: SparkSession,
    raw_folder: str,
    out_folder: str,
    copies: bool = False,
    days: tuple[str, str] | None = None,
) -> Frames:
    """Build and store every layer; each layer reads the stored one before it.

    The joined events are the one wide table. They are stored once, by day, and
    the clean and fact-ordered tables are views of them; with ``copies`` these
    two are stored as well. Lifecycles are merged from stored parts by day.

    With ``days`` (first, last) only what has changed is read: the directories of those
    days, and others whose files differ from the manifest of the last build, are taken as
    new, and all event days that they touch, or that have events of users or tasks whose
    rows changed, are made again from the directories that hold them. The rest of the raw
    log is not read. The tables made of all days are built again from the stored ones.
    The result is that of a run without ``days``.
    """
    out = out_folder.rstrip("/")
    raw = read_raw(spark, raw_folder)
    size_shuffles(spark, raw["ods_todo_event_log"], raw["dim_task"], raw["dim_user"])
    stored, manifest, changes = store_detail(spark, raw, raw_folder, out, copies, days)

    summaries = {
        name: files.publish_ordered(df, f"{out}/summary", name, ORDER[name])
        if name in ORDER
        else files.publish(df, f"{out}/summary", name)
        for name, df in summary_layer(raw, stored).items()
    }
    metrics = metric_layer(
        raw, stored, summaries, lambda df, name: files.publish(df, f"{out}/metrics", name)
    )
    tables = stored | summaries | metrics
    if manifest is not None:
        manifest.store(changes)
    catalog.publish_views(tables)
    return tables


def publish_database(tables: Mapping[str, DataFrame], database: str, keep: int = 2) -> dict[str, int]:
    """Every stored table as a named table of ``database``, replaced whole; the number of
    each new version. A reader of the database never meets a half-written table."""
    return {name: versions.replace_table(df, f"{database}.{name}", keep=keep) for name, df in tables.items()}


def check(raw: Mapping[str, DataFrame]) -> Frames:
    """Data-quality reports on the raw tables."""
    log = raw["ods_todo_event_log"]
    events = detail.typed_events(log)
    return {
        "row_counts": quality.row_counts(raw),
        "schema_report": quality.schema_report(raw, schemas.TABLES),
        "duplicate_log_ids": quality.duplicates(log, "log_id", ["event_time"], spread="user_id"),
        "event_type_distribution": quality.event_type_distribution(log),
        "run_metrics": quality.run_metrics(raw["dim_user"], raw["dim_task"], events),
        "orphan_events": quality.orphan_events(events, raw["dim_user"], raw["dim_task"]),
    }
