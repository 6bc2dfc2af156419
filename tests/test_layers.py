import datetime as dt

import pytest
from pyspark.sql import functions as F

from daybook.operators import derive, detail, summary
from tests.helpers import collect, event_log, tasks, users

D = dt.date

EVENTS = [
    ("e1", "u1", "s1", "2026-07-01 10:00:00", "create_task", "t1"),
    ("e2", "u1", "s1", "2026-07-01 10:05:00", "complete_task", "t1"),
    ("e3", "u2", "s2", "2026-07-02 09:00:00", "edit_task", "t1"),
    ("e4", "u2", "s2", "2026-07-02 09:01:00", "app_launch", None),
    ("e5", "ghost", "s3", "2026-07-02 11:00:00", "app_launch", None),
    ("e6", "ghost2", "s3", "2026-07-02 12:00:00", "create_task", "t9"),
    ("e7", "u1", "s4", "2026-07-03 00:00:01", "delete_task", "t2"),
]
TASKS = [
    {"task_id": "t1", "user_id": "u1", "priority": "high", "due_date": "2026-07-01",
     "create_time": "2026-07-01 10:00:00", "has_reminder": True, "has_subtask": False,
     "is_completed": True, "task_status": "completed"},
    {"task_id": "t2", "user_id": "u1", "priority": "low", "due_date": None,
     "create_time": "2026-07-01 11:00:00", "has_reminder": False, "has_subtask": True,
     "is_completed": False, "task_status": "deleted"},
]


@pytest.fixture
def log(spark):
    return event_log(spark, *EVENTS)


@pytest.fixture
def events(log):
    return detail.typed_events(log)


@pytest.fixture
def task(spark):
    return tasks(spark, *TASKS)


@pytest.fixture
def user(spark):
    return users(spark, "u1", "u2", province="P", city="C", register_channel="app_store")


@pytest.mark.parametrize(
    "options", [{}, {"broadcast_bytes": -1, "rows_per_split": 1}]
)
def test_event_raw_keeps_every_event(log, user, task, options):
    raw = detail.event_raw(log, user, task, **options)
    assert len(raw.columns) == 40
    got = {r["event_id"]: r for r in raw.collect()}
    assert sorted(got) == [e[0] for e in EVENTS]
    assert got["e5"]["province"] is None and got["e1"]["province"] == "P"
    assert got["e4"]["task_priority"] is None and got["e3"]["task_priority"] == "high"
    assert got["e1"]["event_time"] == dt.datetime(2026, 7, 1, 10)
    assert got["e1"]["event_date"] == D(2026, 7, 1)
    clean = detail.event_clean(raw)
    fact = detail.event_detail(clean)
    assert len(clean.columns) == 36 and set(clean.columns) == set(fact.columns)
    assert fact.columns[:4] == ["event_id", "user_id", "task_id", "list_id"]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": -1}, {"broadcast_bytes": -1, "rows_per_split": 1}])
def test_event_raw_of_parts_with_sessions(spark, log, user, task, options, tmp_path):
    """The same rows as sessions first and the whole log at once; events are shuffled
    by task and by user only."""
    typed = log.drop("session_id").withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    typed.write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    whole = detail.event_raw(derive.assign_sessions(log, spread="log_id"), user, task)
    cut = F.col("event_type") == "create_task"
    raw = detail.event_raw([log.filter(cut), log.filter(~cut)], user, task, gap_minutes=30, **options)
    assert raw.columns == whole.columns and collect(raw, "event_id") == collect(whole, "event_id")
    if options == {"broadcast_bytes": -1}:
        plan = raw._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(user_id") <= 2


def test_attributes(log, user, task):
    text = (
        F.when(F.col("log_id") == "e1", '{"priority":"high","due_date":null,"has_reminder":true,"action_duration":3}')
        .when(F.col("log_id") == "e2", "not json")
        .when(F.col("log_id") == "e3", "{}")
        .when(F.col("log_id") == "e4", '{"action_duration":"12.5","result_count":"abc","query":"work"}')
        .when(F.col("log_id") == "e5", '{"new_due_date":"2026-07-09","close_reason":"user_exit","feature_name":"kanban_view"}')
    )
    raw = detail.event_raw(log.withColumn("attributes", text), user, task)
    got = {r["event_id"]: r for r in raw.collect()}
    names = [name for name, _ in detail.ATTRIBUTES.values()]

    def present(event):
        return {n: got[event][n] for n in names if got[event][n] is not None}

    assert present("e1") == {"attr_priority": "high", "attr_has_reminder": True, "action_duration": 3}
    assert present("e2") == present("e3") == present("e6") == {}
    assert present("e4") == {"action_duration": 13, "attr_query": "work"}
    assert present("e5") == {
        "attr_new_due_date": "2026-07-09", "attr_close_reason": "user_exit",
        "attr_feature_name": "kanban_view",
    }


@pytest.mark.parametrize(
    "options", [{}, {"broadcast_bytes": -1, "rows_per_split": 1}]
)
def test_lifecycle(events, task, options):
    out = detail.task_lifecycle(events, task, with_delete_flag=True, **options)
    got = {(r["task_id"], r["user_id"]): r for r in out.collect()}
    # one row per task and actor; events without a task form one row per user
    assert set(got) == {
        ("t1", "u1"), ("t1", "u2"), (None, "u2"), (None, "ghost"), ("t9", "ghost2"), ("t2", "u1"),
    }
    owner, other = got["t1", "u1"], got["t1", "u2"]
    assert owner["complete_duration_seconds"] == 300 and owner["is_completed"]
    assert other["create_time"] is None and not other["is_completed"]
    # last event on the due date is not overdue, the day after is
    assert not owner["is_overdue"] and other["is_overdue"]
    assert got["t2", "u1"]["is_overdue"] is False and got["t2", "u1"]["has_delete_event"]
    assert got["t9", "ghost2"]["priority"] is None


def test_lifecycle_durations(spark, task):
    log = event_log(
        spark,
        ("a", "u", "s", "2026-07-01 00:00:00.9", "create_task", "t1"),
        ("b", "u", "s", "2026-07-01 00:00:02.1", "complete_task", "t1"),
        ("c", "u", "s", "2026-07-01 00:01:00", "create_task", "t2"),
        ("d", "u", "s", "2026-07-01 00:00:50", "complete_task", "t2"),
    )
    out = detail.task_lifecycle(detail.typed_events(log), task)
    assert collect(out.select("task_id", "complete_duration_seconds")) == [("t1", 2), ("t2", -10)]


def test_active_detail(events):
    out = detail.user_active_detail(events)
    got = {(r["user_id"], r["active_date"]): (r["event_cnt"], r["session_cnt"]) for r in out.collect()}
    assert got[("u1", D(2026, 7, 1))] == (2, 1)
    assert got[("u2", D(2026, 7, 2))] == (2, 1)
    assert len(got) == 5


@pytest.mark.parametrize(
    "options", [{}, {"broadcast_bytes": -1, "rows_per_split": 1}]
)
def test_active_1d_puts_unknown_users_together(events, user, options):
    out = summary.user_active_1d(events, user, **options)
    got = {(r["user_id"], r["stat_date"]): r for r in out.collect()}
    unknown = got[None, D(2026, 7, 2)]
    assert (unknown["event_cnt"], unknown["session_cnt"], unknown["task_touch_cnt"]) == (2, 1, 1)
    assert unknown["create_task_flag"] == 1
    first = got["u1", D(2026, 7, 1)]
    assert (first["create_task_flag"], first["complete_task_flag"], first["delete_task_flag"]) == (1, 1, 0)
    assert first["first_active_date"] == first["last_active_date"] == D(2026, 7, 1)


def test_active_1d_of_large_logs_is_the_same(spark, events, user, tmp_path):
    """Users listed twice, unknown and NULL ones; days of known users are not shuffled again."""
    more = events.withColumn("user_id", F.when(F.col("event_id") == "e2", F.lit(None)).otherwise(F.col("user_id")))
    more.unionByName(events).write.parquet(f"{tmp_path}/e")
    twice, log = user.unionByName(user.limit(1)), spark.read.parquet(f"{tmp_path}/e")
    wanted = summary.user_active_1d(log, twice, broadcast_bytes=1 << 40)
    for rows in (1, 1_000_000):
        out = summary.user_active_1d(log, twice, broadcast_bytes=-1, rows_per_split=rows)
        assert collect(out, "user_id", "stat_date") == collect(wanted, "user_id", "stat_date")
    assert "gid" in wanted._jdf.queryExecution().executedPlan().toString()
    known = out.filter("user_id IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert known.count("Expand") <= 1


def test_behavior_summary(events, task):
    cycle = detail.task_lifecycle(events, task)
    out = {r["user_id"]: r for r in summary.user_behavior_summary(events, cycle).collect()}
    assert set(out) == {"u1", "u2", "ghost", "ghost2"}
    u1 = out["u1"]
    assert (u1["total_event_cnt"], u1["active_day_cnt"], u1["last_active_date"]) == (3, 2, D(2026, 7, 3))
    assert (u1["create_task_cnt"], u1["complete_task_cnt"], u1["delete_task_cnt"]) == (1, 1, 1)
    assert u1["completion_rate"] == 1.0 and u1["avg_complete_duration_seconds"] == 300.0
    # no task created: rate 0, no duration
    assert out["ghost"]["completion_rate"] == 0.0
    assert out["ghost"]["avg_complete_duration_seconds"] is None


def test_task_summary(events, task):
    out = summary.task_summary_1d(detail.task_lifecycle(events, task))
    assert collect(out) == [
        (D(2026, 7, 1), 1, 1, 0, 1.0, 300.0),
        (D(2026, 7, 2), 1, 0, 0, 0.0, None),
    ]


def active(spark, *days):
    return spark.createDataFrame(list(days), "user_id string, active_date date")


def test_retention(spark):
    frame = active(
        spark,
        *[("u", D(2026, 7, 1) + dt.timedelta(days=n)) for n in (0, 1, 7, 30)],
        ("v", D(2026, 7, 1)), ("late", D(2026, 7, 31)), (None, D(2026, 7, 2)),
    )
    assert collect(summary.user_retain_summary(frame)) == [
        (D(2026, 7, 1), 2, 1, 1, 1),
        (D(2026, 7, 2), 0, 0, 0, 0),
        (D(2026, 7, 31), 1, 0, 0, 0),
    ]
    censored = collect(summary.user_retain_summary(frame, censor=True))
    assert censored[0] == (D(2026, 7, 1), 2, 1, 1, 1)
    assert censored[2] == (D(2026, 7, 31), 1, None, None, None)


def test_new_and_old_users(spark):
    frame = active(
        spark, ("u", D(2026, 7, 1)), ("u", D(2026, 7, 2)), ("v", D(2026, 7, 2)), (None, D(2026, 7, 3))
    )
    assert collect(summary.new_old_user_summary(frame)) == [
        (D(2026, 7, 1), 1, 0), (D(2026, 7, 2), 1, 1), (D(2026, 7, 3), 0, 0),
    ]


def test_feature_usage_counts_an_event_per_lifecycle_row(events, task):
    cycle = detail.task_lifecycle(events, task)
    # t1 has two lifecycle rows, so its events of a day count twice
    plain = (
        events.join(cycle.drop("user_id"), "task_id", "left")
        .groupBy(F.col("event_time").cast("date").alias("stat_date"))
        .agg(
            F.avg(F.when(F.col("has_reminder"), 1.0).otherwise(0.0)).alias("a"),
            F.avg(F.when(F.col("has_subtask"), 1.0).otherwise(0.0)).alias("b"),
            F.avg(F.when(F.col("due_date").isNotNull(), 1.0).otherwise(0.0)).alias("c"),
        )
    )
    assert collect(summary.user_feature_usage_summary(events, cycle)) == collect(plain)
    by_task = collect(summary.user_feature_usage_summary(events, task, dedupe_task=True))
    assert by_task[1] == (D(2026, 7, 2), 0.25, 0.0, 0.25)


def test_channel_region(events, user):
    assert collect(summary.channel_region_summary(events, user)) == [
        (D(2026, 7, 1), "app_store", "P", "C", 1, 2),
        (D(2026, 7, 2), None, None, None, 2, 2),
        (D(2026, 7, 2), "app_store", "P", "C", 1, 2),
        (D(2026, 7, 3), "app_store", "P", "C", 1, 1),
    ]


def test_shares_and_hours_add_up(events):
    shares = summary.event_type_summary_1d(events).groupBy("stat_date").agg(
        F.sum("event_ratio").alias("r"), F.sum("event_ratio_pct").alias("p")
    )
    for row in shares.collect():
        assert row["r"] == pytest.approx(1, abs=2e-4) and row["p"] == pytest.approx(100, abs=2e-2)
    hours = summary.hour_active_summary(events).agg(F.sum("event_cnt")).first()[0]
    assert hours == len(EVENTS)
