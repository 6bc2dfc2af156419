"""Frequent sequences, ordered funnel, bitmaps of users, completeness, limits, rollup."""

import datetime as dt
import itertools
import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from daybook.operators import activity, bitmaps, derive, lifecycle, quality, sequences, summary
from daybook.sources import files
from tests.helpers import collect

START = dt.datetime(2026, 7, 1)


def events_of(spark, seed, sessions=30, most=9, kinds="abcd"):
    """Random sessions and one with as many events as all others together."""
    rng = random.Random(seed)
    rows = [(f"s{s}", rng.choice(kinds), rng.randrange(600)) for s in range(sessions) for _ in range(rng.randrange(most))]
    rows += [("hot", rng.choice(kinds), rng.randrange(6000)) for _ in range(len(rows))]
    values = [(s, k, START + dt.timedelta(seconds=t), f"{n:05d}") for n, (s, k, t) in enumerate(rows)]
    values.append((None, "a", START, "z"))
    return values, spark.createDataFrame(values, "session_id string, event_type string, event_time timestamp_ntz, event_id string")


@pytest.mark.parametrize("seed, chunk", [(1, 60), (2, 5), (3, 100_000)])
def test_frequent_sequences_follow_the_definition(spark, seed, chunk):
    values, events = events_of(spark, seed)
    by_session = defaultdict(list)
    for s, kind, at, tie in sorted((v for v in values if v[0]), key=lambda v: (v[2], v[3])):
        by_session[s].append(kind)
    wanted = Counter()
    for kinds in by_session.values():
        found = set()
        for seq in (s for n in (1, 2, 3) for s in itertools.product("abcd", repeat=n)):
            rest = iter(kinds)
            if all(step in rest for step in seq):
                found.add(" > ".join(seq))
        wanted.update(found)
    out = sequences.frequent_sequences(events, 8, 3, chunk_seconds=chunk)
    assert {r.sequence: r.session_cnt for r in out.collect()} == {s: n for s, n in wanted.items() if n >= 8}
    assert all(r.length == len(r.sequence.split(" > ")) for r in out.collect())


def test_sequences_and_transitions_by_user_shuffle_the_log_once(spark, tmp_path):
    """The same rows as without ``by``; what is together by user stays where it is."""
    _, events = events_of(spark, 5)
    events.withColumn("user_id", F.col("session_id")).write.parquet(f"{tmp_path}/e")
    dealt = spark.read.parquet(f"{tmp_path}/e").repartition("user_id")
    plain, together = (sequences.frequent_sequences(dealt, 8, 3, by=by) for by in ((), ["user_id"]))
    assert collect(plain) == collect(together)
    plain, together = (derive.event_transitions(dealt, by=by) for by in ((), ["user_id"]))
    assert collect(plain) == collect(together)
    rows = dealt.selectExpr(
        "user_id", "session_id AS session", "floor(second(event_time) / 10) AS chunk",
        "struct(event_time AS at, event_id AS tie) AS place", "event_type AS type",
    ).filter("session IS NOT NULL")
    chunks = sequences.session_chunks(rows, list("abcd"), ["user_id"])
    assert chunks._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_sessions_with_one_event_are_counted_but_not_stored(spark):
    _, events = events_of(spark, 6, most=2)
    rows = events.selectExpr(
        "session_id AS session", "0 AS chunk", "struct(event_time AS at, event_id AS tie) AS place", "event_type AS type"
    ).filter("session IS NOT NULL")
    assert {r.session for r in sequences.session_chunks(rows, list("abcd")).collect()} == {"hot"}
    singles = {r.sequence: r.session_cnt for r in sequences.frequent_sequences(events, 1, 1).collect()}
    assert singles == {r.type: r.n for r in rows.groupBy("type").agg(F.countDistinct("session").alias("n")).collect()}


def test_sequences_of_nothing(spark):
    _, events = events_of(spark, 1)
    assert sequences.frequent_sequences(events.filter("false"), 1).collect() == []
    assert sequences.frequent_sequences(events, 10_000).collect() == []


@pytest.mark.parametrize("chunk", [1, 60, 100_000])
def test_transitions_of_a_hot_session(spark, chunk):
    values, events = events_of(spark, 4)
    in_order = sorted((v for v in values if v[0]), key=lambda v: (v[0], v[2], v[3]))
    wanted = Counter((a[1], b[1]) for a, b in itertools.pairwise(in_order) if a[0] == b[0])
    out = derive.event_transitions(events, chunk_seconds=chunk)
    assert {(r.from_event, r.to_event): r.transition_cnt for r in out.collect()} == wanted


def test_funnel_takes_steps_in_order_and_in_time(spark):
    day = lambda n: START + dt.timedelta(days=n)
    rows = [
        ("t1", "create", 0), ("t1", "edit", 1), ("t1", "complete", 2), ("t1", "delete", 3),
        ("t2", "edit", 0), ("t2", "create", 1), ("t2", "complete", 2),  # the edit comes too soon
        ("t3", "create", 0), ("t3", "edit", 5), ("t3", "edit", 11), ("t3", "complete", 11),  # complete is late
        ("t4", "create", 0), ("t4", "complete", 0), ("t4", "edit", 0), ("t4", "delete", 10),
        ("t5", "complete", 1), ("t6", "create", 2), ("t6", "create", 0), ("t6", "edit", 11), (None, "create", 0),
    ]
    values = [(t, k, day(n), str(i)) for i, (t, k, n) in enumerate(rows)]
    events = spark.createDataFrame(values, "task_id string, event_type string, event_time timestamp_ntz, event_id string")
    steps = ("create", "edit", "complete", "delete")
    for options in ({}, {"broadcast_bytes": -1, "rows_per_split": 2}):
        out = lifecycle.ordered_funnel(events, steps, within_days=10, **options)
        assert collect(out, "step_no") == [
            (1, "create", 2, 5, 100.0), (2, "edit", 1, 3, 60.0), (3, "complete", 0, 2, 40.0), (4, "delete", 2, 2, 40.0),
        ]


def test_sketched_quantiles_are_near(spark):
    rng = random.Random(3)
    values = [
        (p, START + dt.timedelta(days=rng.randrange(30)), int(rng.expovariate(1e-4))) for p in ("high", "low", None) for _ in range(4000)
    ]
    cycle = spark.createDataFrame(values, "priority string, first_complete_time timestamp_ntz, complete_duration_seconds bigint")
    sketches = lifecycle.duration_sketches(cycle)
    assert sketches.count() == 60
    errors = lifecycle.rank_errors(lifecycle.sketched_box(sketches), cycle).collect()
    assert len(errors) == 10 and {r.n for r in errors} == {4000}
    assert all(r.rank_error <= 0.03 for r in errors)
    exact = lifecycle.duration_box_by_priority(cycle)
    assert all(r.rank_error == 0 for r in lifecycle.rank_errors(exact, cycle).collect() if r.quantile[:3] in ("min", "max"))


def active_days(spark, seed=5, users=300, days=80):
    rng = random.Random(seed)
    rows = [(f"u{rng.randrange(users) ** 2 // users}", (START + dt.timedelta(days=rng.randrange(days))).date()) for _ in range(2500)]
    rows += [(None, (START + dt.timedelta(days=n)).date()) for n in (0, 85)]
    return rows, spark.createDataFrame(rows, "user_id string, stat_date date")


def test_bitmaps_give_the_same_trend(spark, tmp_path):
    rows, active = active_days(spark)
    numbers = bitmaps.number_users(active)
    assert sorted(r.user_no for r in numbers.collect()) == list(range(1, len({u for u, _ in rows if u}) + 1))
    daily = bitmaps.daily_bitmaps(active.join(numbers, "user_id", "left"))
    stored = files.publish(daily, str(tmp_path), "daily")
    assert collect(bitmaps.trailing_users(stored)) == collect(activity.activity_trend(active).select("date", "dau", "wau", "mau"))
    week = F.datediff("date", F.lit("2026-06-29").cast("date")).cast("bigint")
    found = {r.w: (r.users, r.kept_users) for r in bitmaps.kept_users(stored, F.floor(week / 7), "w").collect()}
    by_week = defaultdict(set)
    for user, day in rows:
        if user:
            by_week[(day - dt.date(2026, 6, 29)).days // 7].add(user)
    assert found == {w: (len(u), len(u & by_week.get(w - 1, set()))) for w, u in by_week.items()}
    assert {r.w: r.users for r in bitmaps.period_users(stored, F.floor(week / 7), "w").collect()} == {w: len(u) for w, u in by_week.items()}


def test_bitmaps_of_many_buckets(spark):
    active = spark.range(200_000).selectExpr("id * 7 AS user_no", "date_add(date'2026-07-01', CAST(id % 3 AS INT)) AS stat_date")
    out = {str(r.date): (r.dau, r.w) for r in bitmaps.trailing_users(bitmaps.daily_bitmaps(active), {"w": 2}).collect()}
    assert out == {"2026-07-01": (66667, 66667), "2026-07-02": (66667, 133334), "2026-07-03": (66666, 133333)}


def test_known_users_keep_their_numbers(spark):
    _, active = active_days(spark)
    early = active.filter("stat_date < '2026-07-10'")
    first = bitmaps.number_users(early)
    both = {r.user_id: r.user_no for r in bitmaps.number_users(active, first).collect()}
    assert {r.user_id: r.user_no for r in first.collect()}.items() <= both.items()
    assert sorted(both.values()) == list(range(1, len(both) + 1))


@pytest.mark.parametrize("workdays", [False, True])
def test_missing_days(spark, workdays):
    rng = random.Random(7)
    days = [START.date() + dt.timedelta(days=n) for n in range(40)]
    frame = [d for d in days if not workdays or d.weekday() < 5]
    rows = [(k, rng.choice(("x", None)), rng.choice(days)) for k in "abc" for _ in range(25)]
    events = spark.createDataFrame(rows * 3, "event_type string, device string, event_time date")
    calendar = spark.createDataFrame([(d,) for d in frame], "date date")
    wanted = set()
    for key in {r[:2] for r in rows if r[2] in frame}:
        run = []
        for d in [*frame, None]:
            if d is not None and (*key, d) not in rows:
                run.append(d)
            elif run:
                wanted.add((*key, run[0], run[-1], len(run)))
                run = []
    assert {tuple(r) for r in quality.missing_days(events, ["event_type", "device"], calendar).collect()} == wanted


def test_limits_and_what_is_beyond(spark):
    rng = random.Random(9)
    rows = [(g, round(rng.gauss(mu, 3), 2)) for g, mu in (("a", 10), ("b", -50)) for _ in range(501)]
    rows += [("a", 500.0), ("b", 10.0), ("c", None), (None, 1.0), ("d", 4.0), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("id", F.monotonically_increasing_id())
    limits = quality.value_limits(df, "g", "v")
    found = {r.g: r for r in limits.collect()}
    assert set(found) == {"a", "b", "d"}
    for g in "ab":
        values = [v for k, v in rows if k == g]
        median = statistics.median(values)
        mad = statistics.median(abs(v - median) for v in values)
        assert found[g].n == 502 and found[g].median == pytest.approx(median, abs=1e-5) and found[g].mad == pytest.approx(mad, abs=1e-5)
        assert found[g].high_limit == pytest.approx(median + 3.5 * 1.4826 * mad, abs=1e-4)
    beyond = {(r.g, r.v) for r in quality.beyond_limits(df, limits, "g", "v").collect()}
    assert {("a", 500.0), ("b", 10.0)} <= beyond and len(beyond) < 10


def test_rollup_counts_users_once_at_every_level(spark):
    rng = random.Random(11)
    users = [(f"u{n}", rng.choice(("web", "app")), rng.choice("PQ"), None if n % 9 == 0 else rng.choice("xy")) for n in range(40)]
    events = [(f"u{rng.randrange(45)}" if rng.random() < 0.95 else None, START + dt.timedelta(hours=rng.randrange(90))) for _ in range(600)]
    out = summary.channel_region_rollup(
        spark.createDataFrame(events, "user_id string, event_time timestamp_ntz"),
        spark.createDataFrame(users, "user_id string, register_channel string, province string, city string"),
    )
    places = {u: p for u, *p in users}
    who, number = defaultdict(set), Counter()
    for user, at in events:
        row = (at.date(), *places.get(user, (None,) * 3))
        for n in range(4):
            for level, key in ((2**n - 1, row[: 4 - n] + (None,) * n), (8 + 2**n - 1, (None, *row[1 : 4 - n], *(None,) * n))):
                who[level, key].add(user)
                number[level, key] += 1
    assert {(r.level, tuple(r)[1:5]): (r.active_user_cnt, r.event_cnt) for r in out.collect()} == {
        k: (len(who[k] - {None}), number[k]) for k in number
    }


def test_calendar_prunes_the_scan_while_the_query_runs(spark, tmp_path):
    """Only the partitions of the chosen days are read."""
    rows = spark.range(280).selectExpr("id", "CAST(date_add(date'2026-07-01', CAST(id % 28 AS INT)) AS STRING) AS event_date")
    files.write_partitioned(rows, f"{tmp_path}/log")
    log = spark.read.schema("id bigint, event_date string").parquet(f"{tmp_path}/log")
    bounds = spark.range(1).selectExpr("date'2026-07-01' AS start", "date'2026-07-28' AS end")
    calendar = files.publish(derive.date_dim(bounds, ["2026-07-04"]), str(tmp_path), "calendar")
    out = activity.of_day_kind(log, calendar, "weekend")
    assert out.count() == 70  # four weekends less a holiday
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    kinds = activity.activity_by_day_kind(
        rows.groupBy(F.col("event_date").cast("date").alias("date")).agg(F.count("*").alias("n")).filter("date < '2026-07-20'"),
        calendar, ["n"],
    )
    assert {r.kind: (r.day_cnt, r.n_total, r.n_per_day) for r in kinds.collect()} == {
        "holiday": (1, 10, 10.0), "weekend": (7, 50, 50 / 7), "workday": (20, 130, 6.5)
    }


def test_stored_tables_are_in_order_and_files_are_skipped(spark, tmp_path):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # small files would come together
    spark.conf.set(setting, "false")
    rows = spark.range(20_000).selectExpr("CAST(id * 7919 % 1000 AS INT) AS day", "id % 24 AS hour", "id").repartition(4)
    try:
        stored = files.publish_ordered(rows, str(tmp_path), "hours", ["day", "hour"])
    finally:
        spark.conf.set(setting, "true")
    assert stored.count() == 20_000
    ranges = (
        stored.groupBy(F.input_file_name().alias("file"))
        .agg(F.min(F.struct("day", "hour")).alias("lo"), F.max(F.struct("day", "hour")).alias("hi"), F.count("*").alias("n"))
        .orderBy("file").collect()
    )
    assert len(ranges) > 1
    assert all(a.hi < b.lo for a, b in itertools.pairwise(ranges))
    import pyarrow.parquet as pq

    parts = [pq.ParquetFile(r.file.removeprefix("file://")) for r in ranges]
    for part in parts:
        rows = [(r["day"], r["hour"]) for r in part.read().to_pylist()]
        assert rows == sorted(rows)
    # The greatest day lies in the last file alone, by the values kept in the footers.
    held = [part.metadata.row_group(0).column(0).statistics for part in parts]
    assert [s.max >= 999 for s in held] == [False] * (len(held) - 1) + [True]
