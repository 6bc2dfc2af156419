"""Summary layer: the nine daily and per-user tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.lookups import ROWS_PER_SPLIT, fits_broadcast, heavy_keys, lookup_join
from daybook.functions.values import ratio, round_scaled


def _day(column: str = "event_time") -> Column:
    return F.col(column).cast("date")


def _saw(event_type: str) -> Column:
    return F.coalesce(F.max((F.col("event_type") == event_type).cast("int")), F.lit(0))


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def user_active_1d(events: DataFrame, user: DataFrame, **join_options) -> DataFrame:
    """Activity per known user and day; events of unknown users share a NULL user.

    Events are reduced to one row per (user, day, session, task) before the user is
    looked up; both distinct counts are made of these rows, in one pass over the log.
    """
    known = user.select("user_id", F.col("user_id").alias("known_user"))
    flags = {
        "create_task_flag": _saw("create_task"),
        "complete_task_flag": _saw("complete_task"),
        "delete_task_flag": _saw("delete_task"),
    }
    reduced = events.groupBy("user_id", _day().alias("stat_date"), "session_id", "task_id").agg(
        F.count(F.lit(1)).alias("events"), *[saw.alias(name) for name, saw in flags.items()]
    )
    spread = ["stat_date", "session_id", "task_id"]

    def by_day(rows: DataFrame, key: str, sessions: Column, tasks: Column) -> DataFrame:
        return rows.groupBy(F.col(key).alias("user_id"), "stat_date").agg(
            F.sum("events").alias("event_cnt"), sessions.alias("session_cnt"), tasks.alias("task_touch_cnt"),
            *[F.max(name).alias(name) for name in flags],
        )

    distinct = F.count_distinct("session_id"), F.count_distinct("task_id")
    if fits_broadcast(events, join_options.get("broadcast_bytes")):
        daily = by_day(lookup_join(reduced, known, "user_id", spread=spread, **join_options), "known_user", *distinct)
    else:
        # The days of a known user are put together where the user's events are, and its
        # first rows counted there, as two distinct counts would be shuffled three times
        # over. Days of unknown users are put together across users.
        limit = join_options.get("rows_per_split", ROWS_PER_SPLIT)
        counts = heavy_keys(events, ["user_id"], limit)["user_id"]
        found = lookup_join(reduced, known, "user_id", spread=spread, counts=counts, **join_options)
        found = found.filter("known_user IS NOT NULL")
        for name, other in (("session_id", "task_id"), ("task_id", "session_id")):
            place = F.row_number().over(Window.partitionBy("user_id", "stat_date", name).orderBy(other))
            found = found.withColumn(f"first_{name}", (F.col(name).isNotNull() & (place == 1)).cast("bigint"))
        no_user = F.lit(None).cast(known.schema["known_user"].dataType)
        unknown = reduced.join(known, "user_id", "left_anti").withColumn("known_user", no_user)
        daily = by_day(found, "user_id", F.sum("first_session_id"), F.sum("first_task_id")).unionByName(
            by_day(unknown, "known_user", *distinct)
        )
    # Within a (user, day) group the first and last day are the day itself.
    return daily.select(
        "user_id",
        "stat_date",
        F.col("stat_date").alias("first_active_date"),
        F.col("stat_date").alias("last_active_date"),
        *daily.columns[2:],
    )


def user_behavior_summary(events: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Per user: events, active days, tasks created, completed and deleted, rate.

    Events are reduced to one row per (user, day) and per (user, task), the
    lifecycle to sums per user, and the three meet in one aggregation by user:
    no distinct count over raw rows and no join.
    """
    days = events.groupBy("user_id", _day().alias("day")).agg(F.count(F.lit(1)).alias("events"))
    tasks = (
        events.filter(
            F.col("task_id").isNotNull()
            & F.col("event_type").isin("create_task", "complete_task", "delete_task")
        )
        .groupBy("user_id", "task_id")
        .agg(
            _saw("create_task").alias("created"),
            _saw("complete_task").alias("completed"),
            _saw("delete_task").alias("deleted"),
        )
        .drop("task_id")
    )
    durations = lifecycle.filter(
        F.col("user_id").isNotNull() & F.col("complete_duration_seconds").isNotNull()
    ).select("user_id", F.col("complete_duration_seconds").alias("duration"))

    totals = (
        days.unionByName(tasks, allowMissingColumns=True)
        .unionByName(durations, allowMissingColumns=True)
        .groupBy("user_id")
        .agg(
            F.sum("events").alias("total_event_cnt"),
            F.count("day").alias("active_day_cnt"),
            F.max("day").alias("last_active_date"),
            F.coalesce(F.sum("created"), F.lit(0)).alias("create_task_cnt"),
            F.coalesce(F.sum("completed"), F.lit(0)).alias("complete_task_cnt"),
            F.coalesce(F.sum("deleted"), F.lit(0)).alias("delete_task_cnt"),
            F.avg("duration").alias("avg_complete_duration_seconds"),
        )
        .filter("total_event_cnt IS NOT NULL")
    )
    rate = F.coalesce(ratio(F.col("complete_task_cnt"), F.col("create_task_cnt")), F.lit(0.0))
    return totals.select(
        *totals.columns[:-1],
        rate.alias("completion_rate"),
        "avg_complete_duration_seconds",
    )


def task_summary_1d(lifecycle: DataFrame) -> DataFrame:
    """Per creation day: tasks created, completed, overdue, rate, mean duration."""
    daily = (
        lifecycle.filter(F.col("create_time").isNotNull())
        .groupBy(_day("create_time").alias("stat_date"))
        .agg(
            F.count(F.lit(1)).alias("task_created_cnt"),
            _count_if(F.col("is_completed")).alias("task_completed_cnt"),
            _count_if(F.col("is_overdue")).alias("overdue_cnt"),
            F.avg("complete_duration_seconds").alias("avg_complete_duration_seconds"),
        )
    )
    return daily.select(
        "stat_date",
        "task_created_cnt",
        "task_completed_cnt",
        "overdue_cnt",
        ratio(F.col("task_completed_cnt"), F.col("task_created_cnt")).alias("completion_rate"),
        "avg_complete_duration_seconds",
    )


def event_type_summary_1d(events: DataFrame) -> DataFrame:
    """Per day and event type: events and their share of the day."""
    counts = events.groupBy(_day().alias("stat_date"), "event_type").agg(
        F.count(F.lit(1)).alias("event_cnt")
    )
    of_day = F.sum("event_cnt").over(Window.partitionBy("stat_date"))
    share = F.col("event_cnt").cast("double")
    return counts.select(
        "stat_date",
        "event_type",
        "event_cnt",
        round_scaled(share / of_day, 4).alias("event_ratio"),
        round_scaled(share * 100.0 / of_day, 2).alias("event_ratio_pct"),
    )


def hour_active_summary(events: DataFrame) -> DataFrame:
    """Per day and hour: events and distinct users."""
    return events.groupBy(
        _day().alias("stat_date"), F.hour("event_time").cast("bigint").alias("active_hour")
    ).agg(
        F.count(F.lit(1)).alias("event_cnt"),
        F.count_distinct("user_id").alias("active_user_cnt"),
    )


def channel_region_summary(events: DataFrame, user: DataFrame, **join_options) -> DataFrame:
    """Per day, channel, province and city: active users and events.

    Events are counted per (user, day) before the user is looked up, so the
    join sees one row per active day and the users need no distinct count.
    """
    active = events.groupBy("user_id", _day().alias("stat_date")).agg(
        F.count(F.lit(1)).alias("events")
    )
    users = user.select("user_id", "register_channel", "province", "city")
    return (
        lookup_join(active, users, "user_id", spread=None, **join_options)
        .groupBy("stat_date", "register_channel", "province", "city")
        .agg(
            F.count("user_id").alias("active_user_cnt"),
            F.sum("events").alias("event_cnt"),
        )
    )


def new_old_user_summary(active: DataFrame) -> DataFrame:
    """Per day: users active for the first time and users seen before.

    ``active`` has one row per user and day. First days are counted from a
    minimum per user; the others of a day are not new.
    """
    known = F.col("user_id").isNotNull().cast("int")
    first = (
        active.groupBy("user_id")
        .agg(F.min("active_date").alias("stat_date"))
        .select("stat_date", known.alias("new"), F.lit(0).alias("seen"))
    )
    seen = active.select(
        F.col("active_date").alias("stat_date"), F.lit(0).alias("new"), known.alias("seen")
    )
    return (
        first.unionByName(seen)
        .groupBy("stat_date")
        .agg(
            F.sum("new").alias("new_user_cnt"),
            (F.sum("seen") - F.sum("new")).alias("old_user_cnt"),
        )
    )


def active_days_since_first(active: DataFrame, *extra: str) -> DataFrame:
    """Active days of each user with the user's first day and the days since."""
    first = F.min("active_date").over(Window.partitionBy("user_id"))
    return active.select(
        "user_id", *extra, "active_date", first.alias("first_active_date")
    ).withColumn("day_index", F.datediff("active_date", "first_active_date"))


def user_retain_summary(
    active: DataFrame,
    offsets: Sequence[int] = (1, 7, 30),
    by: Sequence[str] = (),
    censor: bool = False,
) -> DataFrame:
    """Cohorts by first active day: size, and users active exactly n days later.

    With ``by`` cohorts are split by further columns of ``active``. With
    ``censor`` a count is NULL where day n lies after the last day of the data.
    """
    known = F.col("user_id").isNotNull()
    retained = {
        f"day{n}_retained_users": _count_if(known & (F.col("day_index") == n)) for n in offsets
    }
    cohorts = (
        active_days_since_first(active, *by)
        .groupBy(*by, "first_active_date")
        .agg(
            _count_if(known & (F.col("day_index") == 0)).alias("total_new_users"),
            *[count.alias(name) for name, count in retained.items()],
        )
    )
    if not censor:
        return cohorts
    last_day = active.agg(F.max("active_date").alias("day")).scalar()
    for n, name in zip(offsets, retained):
        seen = F.date_add("first_active_date", n) <= last_day
        cohorts = cohorts.withColumn(name, F.when(seen, F.col(name)))
    return cohorts


def user_feature_usage_summary(
    events: DataFrame, features: DataFrame, dedupe_task: bool = False, **join_options
) -> DataFrame:
    """Per day: share of event rows whose task has a reminder, subtask, due date.

    By default ``features`` is the lifecycle table and an event counts once per
    lifecycle row of its task (at least once); with ``dedupe_task`` it is the
    task dimension. The pairs are not formed: a (day, task) with k events meets
    a task with n rows, x of them with the feature, as k·x out of k·max(n, 1).
    """
    def having(condition: Column, name: str) -> Column:
        return _count_if(condition).alias(name)

    tasks = features.filter(F.col("task_id").isNotNull()).select(
        "task_id", "has_reminder", "has_subtask", "due_date"
    )
    if dedupe_task:
        tasks = tasks.dropDuplicates(["task_id"])
    weights = tasks.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n"),
        having(F.col("has_reminder"), "reminder"),
        having(F.col("has_subtask"), "subtask"),
        having(F.col("due_date").isNotNull(), "due"),
    )
    touched = events.groupBy(_day().alias("stat_date"), "task_id").agg(
        F.count(F.lit(1)).alias("k")
    )
    # A task has at most one row per day here.
    pairs = lookup_join(touched, weights, "task_id", spread=None, **join_options)

    def rate(name: str) -> Column:
        hits = F.sum(F.col("k") * F.coalesce(F.col(name), F.lit(0)))
        return ratio(hits, F.sum(F.col("k") * F.coalesce(F.col("n"), F.lit(1))))

    return pairs.groupBy("stat_date").agg(
        rate("reminder").alias("remind_feature_usage_rate"),
        rate("subtask").alias("subtask_usage_rate"),
        rate("due").alias("due_date_setting_rate"),
    )


# Levels of the rollup, from a day's city up to all days; and the same without the day.
PLACES = ("register_channel", "province", "city")


def channel_region_rollup(events: DataFrame, user: DataFrame, **join_options) -> DataFrame:
    """``channel_region_summary`` at every level of ``ROLLUP(stat_date, channel, province,
    city)`` and of the places over all days, told apart by ``level`` (the bits of
    ``grouping_id`` over these four columns).

    Active users are exact at every level. A user has one channel, province and city, so
    users of a day add up over its places; users of all days are counted from one row
    per user. Events are reduced to these rows once and only the counts of places are
    rolled up.
    """
    active = events.groupBy("user_id", _day().alias("stat_date")).agg(F.count(F.lit(1)).alias("events"))
    places = user.select("user_id", *PLACES)
    placed = lookup_join(active, places, "user_id", spread=None, **join_options)
    daily = placed.groupBy("stat_date", *PLACES).agg(
        F.count("user_id").alias("users"), F.sum("events").alias("events")
    )
    per_user = placed.groupBy("user_id", *PLACES).agg(F.sum("events").alias("events"))
    overall = per_user.groupBy(*PLACES).agg(F.count("user_id").alias("users"), F.sum("events").alias("events"))
    totals = [F.sum("users").alias("active_user_cnt"), F.sum("events").alias("event_cnt")]
    by_day = (
        daily.rollup("stat_date", *PLACES).agg(F.grouping_id().alias("level"), *totals)
        # Without a day the users of different days would be added up.
        .filter(F.col("level") < 8)
    )
    of_all = overall.rollup(*PLACES).agg((F.grouping_id() + 8).alias("level"), *totals)
    columns = ["level", "stat_date", *PLACES, "active_user_cnt", "event_cnt"]
    return by_day.select(columns).unionByName(
        of_all.withColumn("stat_date", F.lit(None).cast("date")).select(columns)
    )
