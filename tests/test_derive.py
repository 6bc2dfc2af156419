import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import derive
from tests.helpers import collect, tasks

T = dt.datetime


def stamped(spark, *events):
    df = spark.createDataFrame(list(events), "user_id string, t string, event_id int")
    return df.select("user_id", F.col("t").cast("timestamp_ntz").alias("event_time"), "event_id")


def sessions(df, **options):
    out = derive.assign_sessions(df, spread="event_id", **options)
    return {r["event_id"]: r["session_id"] for r in out.collect()}


def test_gap_of_exactly_the_limit_stays_in_the_session(spark):
    df = stamped(
        spark,
        ("u", "2024-01-01 10:00:00", 1), ("u", "2024-01-01 10:30:00", 2),
        ("v", "2024-01-01 10:00:00", 3), ("v", "2024-01-01 10:30:01", 4),
        ("w", "2024-01-01 10:00:00.000001", 5), ("w", "2024-01-01 10:30:00.000002", 6),
    )
    assert sessions(df) == {
        1: "u_sess_0001", 2: "u_sess_0001", 3: "v_sess_0001", 4: "v_sess_0002",
        5: "w_sess_0001", 6: "w_sess_0002",
    }


def plain_sessions(events, gap):
    """Session numbers by the definition, one user after the other."""
    numbers, last = {}, {}
    for user, time, event in sorted(events, key=lambda e: (e[0], e[1])):
        before = last.get(user)
        n = 1 if before is None else before[1] + (time - before[0] > gap)
        last[user] = (time, n)
        numbers[event] = f"{user}_sess_{n:04d}"
    return numbers


@pytest.mark.parametrize("salted", [False, True])
@pytest.mark.parametrize("minutes", [1, 7, 30])
def test_sessions_follow_the_definition(spark, minutes, salted):
    rng = random.Random(minutes)
    start = T(1969, 12, 30)
    events = [
        (rng.choice("abc"), start + dt.timedelta(microseconds=rng.randrange(0, 4 * 86400 * 10**6)), i)
        for i in range(1500)
    ]
    # one user owns a third of the rows within one slot
    events += [("hot", start + dt.timedelta(seconds=rng.randrange(0, 50)), 2000 + i) for i in range(700)]
    rng.shuffle(events)
    df = spark.createDataFrame(events, "user_id string, event_time timestamp_ntz, event_id int")
    options = (
        {"broadcast_bytes": -1, "rows_per_split": 50} if salted else {}
    )
    expected = plain_sessions(events, dt.timedelta(minutes=minutes))
    assert sessions(df, max_gap_minutes=minutes, **options) == expected


def stored_events(spark, path):
    """Three users, one of them with most events, rows without user or time."""
    rng = random.Random(3)
    users = ["a", "b", None] + ["busy"] * 5
    events = [
        (rng.choice(users), None if i % 29 == 0 else T(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(0, 9000)), i)
        for i in range(900)
    ]
    spark.createDataFrame(events, "user_id string, event_time timestamp_ntz, event_id int").write.parquet(path)
    return events, spark.read.parquet(path)


@pytest.mark.parametrize("rows", [10, 300, 10_000])
@pytest.mark.parametrize("least", [1, 3])
def test_sessions_of_large_logs_follow_the_definition(spark, tmp_path, rows, least):
    """All users in order, all by slots, or the busy one by slots."""
    events, df = stored_events(spark, f"{tmp_path}/events")
    whole = [e for e in events if e[0] is not None and e[1] is not None]
    expected = {e[2]: None for e in events} | plain_sessions(whole, dt.timedelta(minutes=30))
    sizes = {s: list(expected.values()).count(s) for s in expected.values()}
    expected = {e: s for e, s in expected.items() if sizes[s] >= least}
    assert sessions(df, broadcast_bytes=-1, rows_per_split=rows, min_rows=least) == expected


def test_sessions_and_what_follows_by_user_share_a_shuffle(spark, tmp_path):
    _, df = stored_events(spark, f"{tmp_path}/events")
    out = derive.assign_sessions(df, spread="event_id", broadcast_bytes=-1)
    days = out.groupBy("user_id", F.to_date("event_time")).agg(F.count_distinct("session_id"))
    assert days._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_long_session_numbers_are_not_cut(spark):
    df = spark.createDataFrame([(9999,), (10000,), (7,)], "n bigint")
    out = [r[0] for r in df.select(derive.session_id(F.lit("u"), F.col("n"))).collect()]
    assert out == ["u_sess_9999", "u_sess_10000", "u_sess_0007"]


def test_calendar(spark):
    bounds = spark.sql("SELECT date'2026-07-01' AS start, date'2026-08-29' AS end")
    days = collect(derive.date_dim(bounds, ["2026-07-09"]), "date_key")
    assert len(days) == 60
    assert days[0] == ("20260701", "2026-07-01", 2026, 7, 1, 27, 3, 0, 0)
    assert days[3][6:8] == (6, 1) and days[4][6:8] == (7, 1)
    assert [d[1] for d in days if d[-1]] == ["2026-07-09"]


def test_milestones(spark):
    task = tasks(
        spark,
        {"task_id": "a", "create_time": "2026-07-01 10:00:00", "is_completed": True,
         "complete_time": "2026-07-02 10:00:00", "task_status": "deleted"},
        {"task_id": "b", "create_time": "2026-07-03 10:00:00", "is_completed": False,
         "task_status": "active"},
    ).withColumn("delete_time", F.lit("2026-07-04 00:00:00"))
    out = derive.milestone_events(task).select("task_id", "event_type", "event_time")
    assert collect(out) == [
        ("a", "complete_task", "2026-07-02 10:00:00"),
        ("a", "create_task", "2026-07-01 10:00:00"),
        ("a", "delete_task", "2026-07-04 00:00:00"),
        ("b", "create_task", "2026-07-03 10:00:00"),
    ]


def test_packed_attributes_keep_nulls_and_only_their_keys(rows):
    df = rows(
        "event_type string, priority string, due_date string, action_duration int, query string",
        ("complete_task", "high", None, 5, None),
        ("search_task", "high", None, 6, "work"),
        ("view_list", "high", None, 7, None),
    )
    out = {r["event_type"]: r["attributes"] for r in derive.pack_attributes(df).collect()}
    assert out == {
        "complete_task": '{"priority":"high","due_date":null,"action_duration":5}',
        "search_task": '{"action_duration":6,"query":"work","result_count":null}',
        "view_list": '{"action_duration":7}',
    }


def test_postponed_tasks(rows):
    df = rows(
        "task_id string, due_date string, attr_new_due_date string",
        ("a", "2026-07-10", "2026-07-12"), ("a", "2026-07-10", "2026-07-20"),
        ("a", "2026-07-10", "2026-07-01"), ("b", "2026-07-10", "2026-07-10"),
        ("c", None, "2026-07-12"), ("d", "2026-07-10", "junk"), (None, "2026-07-10", "2026-07-12"),
    )
    out = derive.postponed_tasks(df).select(
        "task_id", F.col("latest_due_date").cast("string"), "postpone_cnt"
    )
    assert collect(out) == [("a", "2026-07-20", 2)]


@pytest.mark.parametrize("chunk", [1, 60, 100_000])
def test_transitions_do_not_depend_on_the_chunks(spark, chunk):
    rng = random.Random(5)
    start = T(2024, 1, 1)
    events = [
        (rng.choice(["s1", "s1", "s2", None]), start + dt.timedelta(seconds=rng.randrange(0, 900)), i, rng.choice("xyz"))
        for i in range(800)
    ]
    df = spark.createDataFrame(
        events, "session_id string, event_time timestamp_ntz, event_id int, event_type string"
    )
    wanted = {}
    for session in ("s1", "s2"):
        types = [e[3] for e in sorted(e for e in events if e[0] == session)]
        for pair in zip(types, types[1:]):
            wanted[pair] = wanted.get(pair, 0) + 1
    out = derive.event_transitions(df, chunk_seconds=chunk)
    assert {(r[0], r[1]): r[2] for r in out.collect()} == wanted
