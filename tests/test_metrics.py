import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import activity, features, lifecycle
from tests.helpers import collect

D = dt.date


def active(spark, *values):
    return spark.createDataFrame(list(values), "user_id string, stat_date date")


def day(n):
    return D(2026, 7, 1) + dt.timedelta(days=n - 1)


def test_trailing_window_edges(spark):
    trend = collect(activity.activity_trend(active(spark, ("u", day(1)), ("u", day(8)))), "date")
    assert len(trend) == 8
    assert trend[6][2] == 1 and trend[7][2] == 1


def test_days_of_unknown_users_are_in_the_calendar(rows):
    active = rows(
        "user_id bigint, stat_date date", (1, day(2)), (None, day(1)), (1, day(3)), (None, day(5))
    )
    trend = collect(activity.activity_trend(active))
    assert [(r[0], r[1], r[2]) for r in trend] == [
        (day(1), 0, 0), (day(2), 1, 1), (day(3), 1, 1), (day(4), 0, 1), (day(5), 0, 1)
    ]


def test_matrix_has_every_day_of_the_data(spark):
    curve = spark.range(60).selectExpr(
        "date'2026-07-01' AS cohort_date", "CAST(id AS INT) AS day_index", "1 AS users", "1.0D AS retain_rate"
    )
    assert collect(activity.cohort_matrix(curve)) == [(day(1), n, 1.0) for n in range(60)]
    assert activity.cohort_matrix(curve, [0, 59, 60]).collect() == [(day(1), 1.0, 1.0, None)]


def test_matrix_in_bands_has_every_cell(spark):
    """The registered query is a matrix again, of all day indexes and not of 31."""
    curve = spark.range(70).selectExpr(
        "date'2026-07-01' AS cohort_date", "CAST(id AS INT) AS day_index", "1 AS users", "id / 100 AS retain_rate"
    ).filter("day_index NOT BETWEEN 31 AND 61 AND day_index <> 5")
    rows = activity.cohort_bands(curve, 31).orderBy("first_day_index").collect()
    assert [r["first_day_index"] for r in rows] == [0, 62]
    cells = {r["first_day_index"] + n: r[f"day_{n}"] for r in rows for n in range(31)}
    assert cells == {n: n / 100 if n < 70 and n != 5 else None for n in [*range(31), *range(62, 93)]}


def test_spine_gap(spark):
    trend = collect(activity.activity_trend(active(spark, ("u", day(1)), ("u", day(12)))), "date")
    assert [r[1] for r in trend] == [1] + [0] * 10 + [1]
    assert [r[2] for r in trend] == [1] * 7 + [0] * 4 + [1]
    assert [r[3] for r in trend] == [1] * 12


def test_trailing_windows_follow_the_definition(spark):
    rng = random.Random(3)
    seen = {(f"u{rng.randrange(12)}", day(rng.randrange(1, 90))) for _ in range(120)}
    frame = active(spark, *seen, *list(seen)[:20], (None, day(3)))
    trend = collect(activity.activity_trend(frame, {"w3": 3, "w7": 7, "w30": 30}), "date")
    lo, hi = min(d for _, d in seen), max(d for _, d in seen)
    assert len(trend) == (hi - lo).days + 1

    def users(date, n):
        return len({u for u, d in seen if 0 <= (date - d).days < n})

    for date, *counts in trend:
        assert counts == [users(date, n) for n in (1, 3, 7, 30)]
        assert counts == sorted(counts)


def test_filled_days_and_unreadable_dates(rows):
    frame = rows(
        "user_id string, stat_date string",
        ("u", "2026-07-01"), ("u", "20260701"), ("v", "2026-07-03"), ("v", "bad"), (None, "2026-07-03"),
    )
    assert collect(activity.dau_filled(frame)) == [(day(1), 1), (day(2), 0), (day(3), 1)]


def test_kpis_truncate_means(spark):
    frame = active(spark, ("u", day(1)), ("u", day(2)), ("v", day(2)))
    kpis = {r["metric"]: tuple(r)[1:] for r in activity.activity_kpis(activity.activity_trend(frame)).collect()}
    assert kpis == {"dau": (2, 1, 1), "wau": (2, 1, 1), "mau": (2, 1, 1)}


def test_new_old_share(rows):
    frame = rows(
        "stat_date string, new_user_cnt double, old_user_cnt double",
        ("2026-07-01", 3.0, 1.0), ("2026-07-02", 0.0, 0.0), ("x", 9.0, 9.0),
    )
    assert collect(activity.new_old_share(frame, "2026-07-01")) == [(day(1), 3, 1, 75.0, 25.0)]
    assert collect(activity.new_old_share(frame)) == [(day(2), 0, 0, None, None)]
    assert activity.new_old_share(frame, "2026-07-09").count() == 0
    assert [r[0] for r in activity.new_old_structure(frame).collect()] == [day(1), day(2)]


def test_frequency_buckets(rows):
    frame = rows(
        "user_id string, active_day_cnt string, last_active_date string",
        *[(f"u{i}", n, "2026-07-01") for i, n in enumerate(["0", "1", "4", "5", "14", "15", "x", None])],
    )
    got = {r["freq_bucket"]: r["cnt"] for r in activity.activity_frequency(frame).collect()}
    assert got == {"none": 1, "low": 2, "medium": 2, "high": 1, "unknown": 2}


def test_active_share(rows):
    frame = rows(
        "user_id string, active_day_cnt bigint, last_active_date date", ("a", 3, day(1)), ("b", 0, day(1))
    )
    assert collect(activity.active_share(frame)) == [("active", 1), ("inactive", 1)]
    base = rows("user_id string", ("a",), ("c",), ("d",))
    assert collect(activity.active_share(frame, base)) == [("active", 1), ("inactive", 3)]


def test_retention_rates_and_matrix(spark):
    retain = spark.createDataFrame(
        [(day(1), 4, 2, 1, 0), (day(2), 0, 0, 0, 0)],
        "first_active_date date, total_new_users bigint, day1_retained_users bigint, "
        "day7_retained_users bigint, day30_retained_users bigint",
    )
    long = activity.retention_long(activity.retention_rates(retain))
    got = {(r["date"], r["period"]): r["rate"] for r in long.collect()}
    assert got[day(1), "retain_1d"] == 0.5 and got[day(1), "retain_30d"] == 0.0
    assert got[day(2), "retain_7d"] is None

    days = spark.createDataFrame(
        [("a", day(1)), ("a", day(2)), ("b", day(1)), ("c", day(2)), ("c", day(4))],
        "user_id string, active_date date",
    )
    matrix = activity.cohort_matrix(activity.retention_curve(days), range(4))
    assert collect(matrix) == [(day(1), 1.0, 0.5, None, None), (day(2), 1.0, None, 1.0, None)]


def test_channels(rows):
    frame = rows(
        "register_channel string, province string, active_user_cnt bigint, event_cnt bigint",
        (" web ", "P", 2, 20), ("web", "Q", 3, 30), (None, "P", 1, 10), ("app", None, 5, 50),
    )
    assert collect(activity.channel_totals(frame)) == [("None", 1), ("app", 5), ("web", 5)]
    assert collect(activity.channel_region_totals(frame)) == [
        ("None", "P", 1), ("web", "P", 2), ("web", "Q", 3),
    ]
    retention = rows("channel string, retain_7d double", ("web", 0.5), ("web", 0.25), ("web", None))
    quality = {r["channel"]: r["retain_7d"] for r in activity.channel_quality(frame, retention).collect()}
    assert quality == {"web": 0.375, "app": None, "None": None}


SUMMARY = (
    "stat_date string, task_created_cnt bigint, task_completed_cnt bigint, overdue_cnt bigint, "
    "completion_rate double, avg_complete_duration_seconds double"
)


def test_completion_metrics(rows):
    frame = rows(
        SUMMARY, ("2026-07-01", 10, 5, 1, 0.5, 10.0), ("2026-07-02", 2, 2, 0, 1.0, 5.9),
        ("bad", 1, 0, 0, None, None),
    )
    assert collect(lifecycle.completion_kpis(frame)) == [(13, 7, 1, 0.75, 7)]
    assert collect(lifecycle.completion_overall(frame)) == [(13, 7, pytest.approx(7 / 13 * 100))]
    assert [tuple(r) for r in lifecycle.completion_trend(frame).collect()] == [
        (day(1), 10.0, 5.0, 0.5), (day(2), 2.0, 2.0, 1.0),
    ]
    text = rows(
        "stat_date string, task_created string, task_completed string, task_created_cnt string, "
        "task_completed_cnt string, completion_rate string",
        ("2026-07-01", "9", "9", "4", "x", "12%"),
    )
    assert [tuple(r) for r in lifecycle.completion_trend(text).collect()] == [(day(1), 4.0, 0.0, 0.12)]
    renamed = text.select("task_created", "task_completed")
    assert collect(lifecycle.completion_overall(renamed)) == [(9, 9, 100.0)]
    empty = text.limit(0)
    assert collect(lifecycle.completion_overall(empty)) == [(0, 0, 0.0)]


def test_priorities(rows):
    frame = rows(
        "task_id string, priority string, is_completed boolean, is_overdue boolean",
        ("a", "high", True, False), ("b", "high", False, True), (None, None, False, False),
        ("c", None, True, True),
    )
    stats = lifecycle.priority_stats(frame)
    assert collect(stats) == [("None", 1, 1, 1), ("high", 2, 1, 1)]
    long = {(r["priority"], r["metric_label"]): r["cnt"] for r in lifecycle.priority_long(stats).collect()}
    assert long["high", "total tasks"] == 2 and len(long) == 6


def durations(spark, *values):
    return spark.createDataFrame(list(values), "priority string, complete_duration_seconds bigint")


def test_histogram(spark):
    values = [("p", v) for v in (0, 1, 10, 399, 400, 400)] + [("p", -5), (None, None)]
    out = collect(lifecycle.duration_histogram(durations(spark, *values)))
    assert out == [
        (0, 0.0, 10.0, 2), (1, 10.0, 20.0, 1), (39, 390.0, 400.0, 3),
    ]
    same = collect(lifecycle.duration_histogram(durations(spark, ("p", 7), ("q", 7))))
    assert same == [(0, 7.0, 7.0, 2)]


def test_box(spark):
    out = collect(
        lifecycle.duration_box_by_priority(
            durations(spark, *[("p", v) for v in (1, 2, 3, 4, -9)], ("q", 5), (None, 3), ("r", None))
        )
    )
    assert out == [("p", 4, 1.0, 1.75, 2.5, 3.25, 4.0), ("q", 1, 5.0, 5.0, 5.0, 5.0, 5.0)]


def test_funnel(rows):
    frame = rows(
        "event_type string, task_id string",
        ("CREATE_task", "a"), ("create_task", "a"), ("create_task", "b"), ("complete_task", "a"),
        ("postponed", "z"), ("delayed", "a"), ("create_task", None), (None, "q"),
    )
    out = [tuple(r)[1:] for r in lifecycle.task_funnel(frame).orderBy("step_no").collect()]
    assert out == [
        ("created", 2, 100.0), ("completed", 1, 50.0), ("deleted", 0, 0.0), ("postponed", 2, 100.0),
    ]


def lifecycles(rows):
    return rows(
        "task_id string, user_id string, has_reminder boolean, has_subtask string, due_date string, "
        "is_completed boolean",
        ("a", "u", True, "1", "2026-07-01", True), ("b", "u", False, "true", None, False),
        (None, "v", None, None, None, True), ("c", "w", True, "0", "2026-07-02", False),
    )


def test_feature_effect(rows):
    flags = features.feature_flags(lifecycles(rows))
    assert [tuple(r) for r in flags.orderBy("user_id", "task_id").select("has_reminder", "has_subtask", "has_due_date").collect()] == [
        (1, 1, 1), (0, 0, 0), (0, 0, 0), (1, 0, 1),
    ]
    out = {(r["feature"], r["has_feature"]): tuple(r)[2:] for r in features.completion_by_feature(flags).collect()}
    assert out["reminder", "has"] == (2, 1, 0.5)
    # the row without a task counts as completed but not as a task
    assert out["reminder", "has not"] == (1, 1, 1.0)
    assert len(out) == 6


def test_segments(rows):
    rates = features.user_feature_rates(features.feature_flags(lifecycles(rows)))
    got = {r["user_id"]: tuple(r)[1:] for r in rates.collect()}
    assert got["u"] == (0.5, 0.5, 0.5) and got["v"] == (0.0, 0.0, 0.0)
    user = rows(
        "user_id string, user_group string, user_level string, user_type string",
        ("u", "old_user", "vip", "normal"), ("u", "old_user", "vip", "normal"),
        ("v", "old_user", "free", "normal"), ("w", None, "free", "normal"),
    )
    behavior = rows("user_id string, completion_rate double", ("u", 1.0))
    by_group = features.segment_feature_summary(rates, user, behavior)
    assert collect(by_group) == [("old_user", 0.25, 0.25, 0.25, 0.5)]
    by_level = features.segment_feature_summary(rates, user, behavior, "user_level")
    assert {r["user_level"] for r in by_level.collect()} == {"vip", "free"}
    matrix = features.segment_feature_matrix(features.segment_feature_long(by_group))
    assert collect(matrix) == [("old_user", 0.25, 0.25, 0.25)]


def test_feature_trend(rows):
    frame = rows(
        "stat_date string, remind_feature_usage_rate double, subtask_usage_rate double, due_date_setting_rate double",
        ("2026-07-02", 0.2, 0.4, 0.6), ("2026-07-01", 0.0, 0.0, 0.0), ("2026-07-02", 0.4, 0.4, 0.4),
    )
    assert features.feature_trend(frame).count() == 6
    latest = features.latest_feature_kpi(frame).first()
    assert latest["stat_date"] == day(2)
    assert latest["remind_feature_usage_rate"] == pytest.approx(0.3)
