"""Data-quality checks and run statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daybook.functions.lookups import lookup_join
from daybook.functions.quantiles import exact_quantiles
from daybook.functions.values import ratio, round_scaled
from daybook.session import scratch_path
from daybook.sources.files import publish


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of every table."""
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in tables.items()
        ]
    )


def top_event_types(events: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent event types; equal counts in name order."""
    return (
        events.groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "event_type")
        .limit(n)
    )


def duplicates(
    df: DataFrame, key: str, order: Sequence[str], spread: str | Sequence[str], **join_options
) -> DataFrame:
    """All rows whose key occurs more than once (NULL counts as a key), sorted.

    Keys are counted first and looked up from the rows, so the rows of one key
    need not meet in one task.
    """
    keyed = df.withColumn("_missing", F.col(key).isNull()).withColumn(
        "_value", F.coalesce(F.col(key).cast("string"), F.lit(""))
    )
    counts = keyed.groupBy("_missing", "_value").agg(F.count(F.lit(1)).alias("n"))
    repeated = counts.filter("n > 1").select("_missing", "_value", F.lit(True).alias("_repeated"))
    joined = lookup_join(
        keyed, repeated, ["_missing", "_value"], spread, counts=counts, **join_options
    )
    return joined.filter("_repeated").select(*df.columns).orderBy(key, *order)


def schema_report(
    tables: Mapping[str, DataFrame], expected: Mapping[str, StructType]
) -> DataFrame:
    """Per column: stored type, declared type, whether they agree, missing values."""
    reports = []
    for name, df in tables.items():
        declared = {f.name: f.dataType.simpleString() for f in expected.get(name, StructType())}
        stored = {f.name: f.dataType.simpleString() for f in df.schema}
        missing = df.agg(
            *[F.count(F.when(F.col(f"`{c}`").isNull(), F.lit(1))).alias(c) for c in stored]
        )
        rows = [
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.lit(stored.get(column)).cast("string").alias("data_type"),
                F.lit(declared.get(column)).cast("string").alias("expected_type"),
                F.lit(stored.get(column) == declared.get(column)).alias("matches"),
                (F.col(f"`{column}`") if column in stored else F.lit(None).cast("bigint")).alias(
                    "null_cnt"
                ),
            )
            for column in {**stored, **declared}
        ]
        reports.append(missing.select(F.inline(F.array(*rows))))
    return _union(reports)


def require_row_count(df: DataFrame, low: int, high: int, name: str = "table") -> int:
    """Row count of ``df``; an error outside the range ``low`` … ``high``."""
    rows = df.count()
    if not low <= rows <= high:
        raise ValueError(f"{name} has {rows} rows, expected {low} to {high}")
    return rows


def require_parts_within(total: int, parts: Mapping[str, DataFrame]) -> int:
    """Rows left of ``total`` after the parts; an error where they exceed it."""
    used = row_counts(parts).agg(F.sum("row_count")).first()[0]
    if used > total:
        raise ValueError(f"{used} rows required, but the total is {total}")
    return total - used


def run_metrics(user: DataFrame, task: DataFrame, events: DataFrame) -> DataFrame:
    """Users, inclusive day span, tasks per user, completion rate, events per user-day."""
    users = user.agg(F.count_distinct("user_id").alias("user_cnt"))
    tasks = task.agg(
        F.count(F.lit(1)).alias("task_cnt"), F.avg(F.col("is_completed").cast("int")).alias("rate")
    )
    day = F.col("event_time").cast("date")
    log = events.agg(
        F.count(F.lit(1)).alias("event_cnt"),
        (F.datediff(F.max(day), F.min(day)) + 1).cast("bigint").alias("day_cnt"),
    )
    # Three one-row aggregates, stacked and folded into one row.
    parts = [users, tasks, log]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    row = merged.agg(*[F.max(c).alias(c) for c in merged.columns])
    user_days = F.col("user_cnt") * F.col("day_cnt")
    return row.select(
        "user_cnt",
        "day_cnt",
        ratio(F.col("task_cnt"), F.col("user_cnt")).alias("tasks_per_user"),
        F.col("rate").alias("completion_rate"),
        ratio(F.col("event_cnt"), user_days).alias("events_per_user_day"),
    )


def event_type_distribution(events: DataFrame) -> DataFrame:
    """Share of each event type, rounded to four digits."""
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))
    # One row per event type from here on.
    total = F.sum("cnt").over(Window.partitionBy(F.lit(1)))
    return counts.select(
        "event_type", round_scaled(F.col("cnt").cast("double") / total, 4).alias("share")
    )


def null_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULL per column, in one pass."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return shares.unpivot([], list(columns), "column_name", "null_ratio")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, NULL included."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def orphan_events(
    events: DataFrame,
    user: DataFrame,
    task: DataFrame,
    first_day: Column | None = None,
    last_day: Column | None = None,
) -> DataFrame:
    """Events whose user or task is unknown, or whose day is outside the period.

    Keys are counted before the anti join, so a hot key is one row there.
    """
    def unknown(check: str, key: str, dim: DataFrame) -> DataFrame:
        per_key = (
            events.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"))
        )
        lost = per_key.join(dim.select(key), key, "left_anti")
        return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("event_cnt")).select(
            F.lit(check).alias("check"), "event_cnt"
        )

    day = F.col("event_time").cast("date")
    outside = F.lit(False)
    if first_day is not None:
        outside = outside | (day < first_day)
    if last_day is not None:
        outside = outside | (day > last_day)
    misdated = events.agg(F.count(F.when(outside, F.lit(1))).alias("event_cnt")).select(
        F.lit("outside_period").alias("check"), "event_cnt"
    )
    return _union(
        [unknown("unknown_user", "user_id", user), unknown("unknown_task", "task_id", task), misdated]
    )


def missing_days(
    events: DataFrame, keys: Sequence[str], calendar: DataFrame, time: str = "event_time", day: str = "date"
) -> DataFrame:
    """Completeness: every run of days of the ``calendar`` on which a combination of ``keys``
    has no event, as ``keys, gap_start, gap_end, missing_day_cnt``.

    The calendar is the frame: its days are numbered, so a gap is a step of more than one
    number between two present days, or a part left at either end. Days that it lacks
    (such as weekends in one of working days) are in no gap. Events are reduced to one
    row per combination and day first; a window holds the days of one combination.
    Combinations are those that occur on some day of the calendar.
    """
    # One row for each calendar day, stored, so that its size decides the joins.
    numbered = calendar.select(F.col(day).cast("date").alias("_day")).distinct().select(
        "_day", F.row_number().over(Window.orderBy("_day")).alias("_no")
    )
    numbered = publish(numbered, scratch_path(events.sparkSession, "calendar"), "days")
    last = numbered.agg(F.max("_no").alias("n")).scalar()
    present = events.select(*keys, F.col(time).cast("date").alias("_day")).distinct()
    placed = lookup_join(present, numbered, "_day", spread=None).filter("_no IS NOT NULL")
    in_order = Window.partitionBy(*keys).orderBy("_no")
    edges = placed.select(
        *keys, "_no", F.lag("_no", 1, 0).over(in_order).alias("before"), F.lead("_no").over(in_order).alias("after"),
        last.alias("last"),
    )
    gap = lambda a, b: F.struct(a.alias("_first"), b.alias("_last"))
    gaps = F.array(
        gap(F.col("before") + 1, F.col("_no") - 1),
        gap(F.col("_no") + 1, F.when(F.col("after").isNull(), F.col("last"))),
    )
    found = edges.select(*keys, F.inline(F.filter(gaps, lambda g: g["_last"] >= g["_first"])))
    first, final = (
        numbered.select(F.col("_no").alias(no), F.col("_day").alias(name))
        for no, name in (("_first", "gap_start"), ("_last", "gap_end"))
    )
    dated = lookup_join(lookup_join(found, first, "_first", spread=None), final, "_last", spread=None)
    return dated.select(
        *keys, "gap_start", "gap_end", (F.col("_last") - F.col("_first") + 1).cast("bigint").alias("missing_day_cnt")
    )


# Makes the median absolute deviation of normal values equal their standard deviation.
MAD_SCALE = 1.4826
MAD_BUCKETS = 4096


def _buckets(df: DataFrame, value: str) -> float:
    """Width that cuts the range of a column into ``MAD_BUCKETS``."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    return max((high - low) / MAD_BUCKETS, 1e-9) if low is not None else 1.0


def value_limits(df: DataFrame, group: str, value: str, deviations: float = 3.5, digits: int = 6) -> DataFrame:
    """``group, n, median, mad, low_limit, high_limit`` of a numeric column.

    The median and the median absolute deviation from it are exact quantiles of counts
    per value: one pass each, and no group is gathered. Limits are ``deviations`` scaled
    deviations from the median.
    """
    folder = scratch_path(df.sparkSession, "limits")
    rows = df.select(F.col(group), F.col(value).cast("double").alias("_value")).filter(
        F.col("_value").isNotNull() & ~F.isnan("_value") & F.col(group).isNotNull()
    )
    middle = exact_quantiles(rows, group, "_value", {"median": 0.5}, _buckets(rows, "_value")).withColumn(
        "median", F.round("median", digits)
    )
    middle = publish(middle, folder, "middle")
    apart = lookup_join(rows, middle.select(group, "median"), group, spread="_value").select(
        group, F.round(F.abs(F.col("_value") - F.col("median")), digits).alias("_apart")
    )
    spread = exact_quantiles(apart, group, "_apart", {"mad": 0.5}, _buckets(apart, "_apart")).select(
        group, F.round("mad", digits).alias("mad")
    )
    reach = F.col("mad") * F.lit(MAD_SCALE * deviations)
    limits = middle.join(spread, group).select(
        group, "n", "median", "mad",
        F.round(F.col("median") - reach, digits).alias("low_limit"),
        F.round(F.col("median") + reach, digits).alias("high_limit"),
    )
    return publish(limits, folder, "limits")


def beyond_limits(df: DataFrame, limits: DataFrame, group: str, value: str) -> DataFrame:
    """Reasonableness: the rows of ``df`` whose ``value`` lies outside its group's limits."""
    slim = limits.select(group, "low_limit", "high_limit")
    spread = [c for c in df.columns if c != group]
    return lookup_join(df, slim, group, spread=spread).filter(
        (F.col(value) < F.col("low_limit")) | (F.col(value) > F.col("high_limit"))
    )
