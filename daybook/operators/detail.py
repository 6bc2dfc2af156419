"""Detail layer: typed and enriched events, task lifecycles, user activity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.lookups import ROWS_PER_SPLIT, fits_broadcast, heavy_keys, key_counts, lookup_join
from daybook.functions.times import second_diff
from daybook.functions.values import soft_bool, soft_int
from daybook.operators.derive import ROWS_PER_USER, assign_sessions

USER_COLUMNS = (
    "province", "city", "user_level", "user_type", "gender", "age_group", "is_active",
    "register_channel",
)

# JSON key → output column, and how its text is read.
ATTRIBUTES = {
    "priority": ("attr_priority", "text"),
    "due_date": ("attr_due_date", "text"),
    "has_reminder": ("attr_has_reminder", "boolean"),
    "has_subtask": ("attr_has_subtask", "boolean"),
    "action_duration": ("action_duration", "integer"),
    "new_priority": ("attr_new_priority", "text"),
    "new_due_date": ("attr_new_due_date", "text"),
    "query": ("attr_query", "text"),
    "result_count": ("attr_result_count", "integer"),
    "feature_name": ("attr_feature_name", "text"),
    "close_reason": ("attr_close_reason", "text"),
}
READERS = {"text": lambda text: text, "boolean": soft_bool, "integer": soft_int}

# Attributes that repeat what the task dimension says.
REDUNDANT = ("attr_priority", "attr_due_date", "attr_has_reminder", "attr_has_subtask")

# Column order of the fact table.
FACT_ORDER = (
    "event_id", "user_id", "task_id", "list_id", "event_type", "event_time", "event_date",
    "session_id", "device_type", "os", "app_version", "network_type", "province", "city",
    "user_level", "user_type", "gender", "age_group", "is_active", "register_channel",
    "task_priority", "due_date", "task_create_time", "task_complete_time", "task_is_completed",
    "has_subtask", "has_reminder", "task_status", "action_duration", "attr_new_priority",
    "attr_new_due_date", "attr_query", "attr_result_count", "attr_feature_name",
    "attr_close_reason", "attributes",
)


def typed_events(log: DataFrame) -> DataFrame:
    """Raw log with ``event_id``, a typed ``event_time`` and its ``event_date``."""
    time = F.col("event_time").cast("timestamp_ntz")
    kept = [c for c in log.columns if c not in ("log_id", "event_time", "event_date")]
    return log.select(
        F.col("log_id").alias("event_id"),
        time.alias("event_time"),
        time.cast("date").alias("event_date"),
        *kept,
    )


def attribute_columns(attributes: Column) -> Column:
    """One parse of the JSON text into a struct of text fields; bad JSON is NULL."""
    return F.from_json(attributes, ", ".join(f"`{key}` STRING" for key in ATTRIBUTES))


def event_raw(
    log: DataFrame | Sequence[DataFrame],
    user: DataFrame,
    task: DataFrame,
    gap_minutes: int | None = None,
    **join_options,
) -> DataFrame:
    """Typed events with their user, their task and their JSON attributes.

    ``log`` may come in parts with the same columns: the task is looked up in each, so
    that a part that is in order by task already is not shuffled for it. With
    ``gap_minutes`` sessions are assigned on the way, in the shuffle by user that the
    lookup of users needs too.
    """
    parts = [log] if isinstance(log, DataFrame) else list(log)
    whole = reduce(DataFrame.unionByName, parts)
    users = user.select("user_id", *USER_COLUMNS)
    tasks = task.select(
        "task_id",
        F.col("priority").alias("task_priority"),
        "due_date",
        F.col("create_time").cast("timestamp_ntz").alias("task_create_time"),
        F.col("complete_time").cast("timestamp_ntz").alias("task_complete_time"),
        F.col("is_completed").alias("task_is_completed"),
        "has_subtask",
        "has_reminder",
        "task_status",
    )
    # Keys of the joins that have to shuffle are counted in one scan.
    limit = join_options.get("broadcast_bytes")
    shuffled = [key for key, dim in (("task_id", tasks), ("user_id", users)) if not fits_broadcast(dim, limit)]
    by_user = gap_minutes is not None and not fits_broadcast(whole, limit)
    rows = join_options.get("rows_per_split", ROWS_PER_SPLIT)
    if by_user:
        shuffled = [key for key in shuffled if key != "user_id"]
        counts = heavy_keys(whole, [*shuffled, "user_id"], min(rows, ROWS_PER_USER), nulls=True)
    else:
        counts = heavy_keys(whole, shuffled, rows)
    # Most events have no task; where the task join has to shuffle, they stay out.
    events = reduce(DataFrame.unionByName, [
        lookup_join(
            typed_events(part), tasks, "task_id", spread="event_id", counts=counts.get("task_id"),
            split_nulls=True, **join_options,
        )
        for part in parts
    ])
    if gap_minutes is not None:
        events = assign_sessions(
            events, max_gap_minutes=gap_minutes, spread="event_id",
            heavy=counts["user_id"] if by_user else None, **join_options,
        )
    events = lookup_join(
        events, users, "user_id", spread="event_id", counts=counts.get("user_id"), **join_options
    )
    events = events.withColumn("attribute", attribute_columns(F.col("attributes")))
    read = [
        READERS[kind](F.col(f"attribute.{key}")).alias(name)
        for key, (name, kind) in ATTRIBUTES.items()
    ]
    return events.select(
        "event_id", "user_id", "session_id", "event_time", "event_date", "event_type",
        "task_id", "list_id", "device_type", "os", "app_version", "network_type",
        *USER_COLUMNS, *tasks.columns[1:], *read, "attributes",
    )


def event_clean(raw: DataFrame) -> DataFrame:
    """``event_raw`` without the attributes the task dimension already holds."""
    return raw.drop(*REDUNDANT)


def event_detail(clean: DataFrame) -> DataFrame:
    """Clean events in the column order of the fact table."""
    return clean.select(*FACT_ORDER)


def lifecycle_stats(events: DataFrame, with_delete_flag: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Earliest and latest times per task and acting user, and per ``by``."""
    def when_type(name: str) -> Column:
        return F.when(F.col("event_type") == name, F.col("event_time"))

    measures = [
        F.min(when_type("create_task")).alias("create_time"),
        F.min(when_type("complete_task")).alias("first_complete_time"),
        F.max("event_time").alias("last_update_time"),
        F.max(F.col("event_type") == "complete_task").alias("saw_complete"),
    ]
    if with_delete_flag:
        deleted = F.max(F.col("event_type") == "delete_task")
        measures.append(F.coalesce(deleted, F.lit(False)).alias("has_delete_event"))
    return events.groupBy("task_id", "user_id", *by).agg(*measures)


def merged_stats(parts: DataFrame) -> DataFrame:
    """``lifecycle_stats`` from those of parts of the events, such as days."""
    measures = {
        "create_time": F.min, "first_complete_time": F.min, "last_update_time": F.max,
        "saw_complete": F.max, "has_delete_event": F.max,
    }
    return parts.groupBy("task_id", "user_id").agg(
        *[fold(name).alias(name) for name, fold in measures.items() if name in parts.columns]
    )


def lifecycle_of(stats: DataFrame, task: DataFrame, counts: DataFrame, **join_options) -> DataFrame:
    """Lifecycle rows from ``lifecycle_stats``; ``counts`` bounds the rows of each task."""
    tasks = task.select(
        "task_id", "priority", "has_reminder", "has_subtask", "task_status", "due_date"
    )
    joined = lookup_join(stats, tasks, "task_id", spread="user_id", counts=counts, **join_options)
    overdue = F.col("last_update_time").cast("date") > F.col("due_date").cast("date")
    return joined.select(
        "task_id",
        "user_id",
        "create_time",
        "first_complete_time",
        "last_update_time",
        second_diff(F.col("create_time"), F.col("first_complete_time")).alias(
            "complete_duration_seconds"
        ),
        F.coalesce("saw_complete", F.lit(False)).alias("is_completed"),
        F.coalesce(overdue, F.lit(False)).alias("is_overdue"),
        "priority",
        "has_reminder",
        "has_subtask",
        "task_status",
        "due_date",
        *[c for c in stats.columns if c == "has_delete_event"],
    )


def task_lifecycle(
    events: DataFrame, task: DataFrame, with_delete_flag: bool = False, **join_options
) -> DataFrame:
    """One row per task and acting user: milestones, duration, completion, overdue.

    Events without a task form one row per user with a NULL task, as an event
    of another user on the task forms a row of its own.
    """
    # The events of a task bound its rows here, and are cheaper to count.
    return lifecycle_of(
        lifecycle_stats(events, with_delete_flag), task, key_counts(events, "task_id"), **join_options
    )


def user_active_detail(events: DataFrame) -> DataFrame:
    """One row per user and active day: first and last event, events, sessions."""
    return events.groupBy(
        "user_id", F.col("event_time").cast("date").alias("active_date")
    ).agg(
        F.min("event_time").alias("first_event_time"),
        F.max("event_time").alias("last_event_time"),
        F.count(F.lit(1)).alias("event_cnt"),
        F.count_distinct("session_id").alias("session_cnt"),
    )
