"""Feature-use metrics: trend, effect on completion, differences by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.values import flag, lenient_date, ratio

TREND_RATES = ("remind_feature_usage_rate", "subtask_usage_rate", "due_date_setting_rate")
USER_RATES = ("remind_rate", "subtask_rate", "due_rate")
SEGMENTS = ("user_group", "user_level", "user_type")


def _daily_rates(usage: DataFrame) -> DataFrame:
    return (
        usage.withColumn("stat_date", lenient_date(usage, "stat_date"))
        .filter(F.col("stat_date").isNotNull())
        .groupBy("stat_date")
        .agg(*[F.avg(r).alias(r) for r in TREND_RATES])
    )


def feature_trend(usage: DataFrame) -> DataFrame:
    """Mean rate per day and feature, long form in date order."""
    long = _daily_rates(usage).unpivot(["stat_date"], list(TREND_RATES), "feature", "rate")
    return long.orderBy("stat_date", "feature")


def latest_feature_kpi(usage: DataFrame) -> DataFrame:
    """The newest day's three rates."""
    return _daily_rates(usage).orderBy(F.desc("stat_date")).limit(1)


def feature_flags(lifecycle: DataFrame) -> DataFrame:
    """Lifecycle rows with reminder, subtask and due date as 0/1."""
    return lifecycle.withColumns(
        {
            "has_reminder": flag(lifecycle, "has_reminder"),
            "has_subtask": flag(lifecycle, "has_subtask"),
            "has_due_date": F.col("due_date").isNotNull().cast("int"),
        }
    )


# Feature name → flag column.
FEATURES = {"reminder": "has_reminder", "subtask": "has_subtask", "due_date": "has_due_date"}


def completion_by_feature(flags: DataFrame) -> DataFrame:
    """Tasks, completed rows and rate with and without each feature.

    Rows are first combined per flag combination (at most eight), and only
    those are regrouped per feature.
    """
    combined = flags.groupBy(*FEATURES.values()).agg(
        F.count("task_id").alias("tasks"),
        F.count(F.when(F.col("is_completed"), F.lit(1))).alias("done"),
    )
    per_feature = [
        F.struct(
            F.lit(name).alias("feature"),
            F.when(F.col(column) == 1, F.lit("has")).otherwise(F.lit("has not")).alias("has_feature"),
            "tasks",
            "done",
        )
        for name, column in FEATURES.items()
    ]
    return (
        combined.select(F.inline(F.array(*per_feature)))
        .groupBy("feature", "has_feature")
        .agg(F.sum("tasks").alias("tasks_total"), F.sum("done").alias("tasks_completed"))
        .withColumn("completion_rate", ratio(F.col("tasks_completed"), F.col("tasks_total")))
    )


def user_feature_rates(flags: DataFrame) -> DataFrame:
    """Per user: mean of the three flags over the user's lifecycle rows."""
    def mean(column: str) -> Column:
        return F.avg(F.col(column))

    return (
        flags.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            mean("has_reminder").alias("remind_rate"),
            mean("has_subtask").alias("subtask_rate"),
            mean("has_due_date").alias("due_rate"),
        )
    )


def _segmented(rates: DataFrame, user: DataFrame, behavior: DataFrame) -> DataFrame:
    users = user.select("user_id", *SEGMENTS).distinct()
    completion = behavior.select("user_id", "completion_rate").distinct()
    return rates.join(users, "user_id", "left").join(completion, "user_id", "left")


def segment_feature_summary(
    rates: DataFrame, user: DataFrame, behavior: DataFrame, segment: str = "user_group"
) -> DataFrame:
    """Mean user rates per segment; users without a segment are left out."""
    merged = (
        _segmented(rates, user, behavior)
        .filter(F.col(segment).isNotNull())
        .na.fill(0.0, ["completion_rate"])
    )
    columns = [*USER_RATES, "completion_rate"]
    return (
        merged.groupBy(segment).agg(*[F.avg(c).alias(c) for c in columns]).na.fill(0.0, columns)
    )


def segment_feature_long(summary: DataFrame, segment: str = "user_group") -> DataFrame:
    """One row per segment and feature."""
    return summary.unpivot([segment], list(USER_RATES), "feature", "rate")


def segment_feature_matrix(long: DataFrame, segment: str = "user_group") -> DataFrame:
    """Segment × feature → rate."""
    return long.groupBy(segment).pivot("feature", list(USER_RATES)).agg(F.max("rate"))
