import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from daybook import schemas, session
from daybook.operators import detail, quality
from daybook.plans import layers
from daybook.sources import catalog, files
from tests.helpers import collect, event_log, tasks, users
from tests.test_layers import EVENTS, TASKS


@pytest.fixture
def log(spark):
    return event_log(spark, *EVENTS).withColumn("event_date", F.substring("event_time", 1, 10))


def test_flat_and_partitioned_logs_agree(spark, log, tmp_path):
    files.write_table(log.drop("event_date"), f"{tmp_path}/flat")
    files.write_partitioned(log, f"{tmp_path}/days")
    flat = files.read_table(spark, f"{tmp_path}/flat", schemas.EVENT_LOG)
    days = files.read_event_log(spark, f"{tmp_path}/days")
    assert dict(days.dtypes)["event_date"] == "string"
    assert collect(days.drop("event_date")) == collect(flat)
    assert os.path.isdir(f"{tmp_path}/days/event_date=2026-07-01")


def test_date_bounds_prune_partitions(spark, log, tmp_path):
    files.write_partitioned(log, f"{tmp_path}/days")
    some = files.read_event_log(spark, f"{tmp_path}/days", "2026-07-02", "2026-07-02")
    assert {r["event_date"] for r in some.collect()} == {"2026-07-02"} and some.count() == 4
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_bounds_of_a_flat_log(spark, log, tmp_path):
    files.write_table(log.drop("event_date"), f"{tmp_path}/flat")
    every = files.read_event_log(spark, f"{tmp_path}/flat")
    assert every.count() == log.count()
    days = [r[0] for r in every.select("event_date").distinct().collect()]
    for day in days:
        some = files.read_event_log(spark, f"{tmp_path}/flat", day, day)
        assert some.count() == every.filter(F.col("event_date") == day).count() > 0


def test_rerun_replaces_only_its_days(spark, log, tmp_path):
    path = f"{tmp_path}/days"
    files.write_partitioned(log, path)
    files.write_partitioned(log.filter("event_date = '2026-07-02'").limit(1), path)
    counts = files.read_event_log(spark, path).groupBy("event_date").count()
    assert collect(counts) == [("2026-07-01", 2), ("2026-07-02", 1), ("2026-07-03", 1)]
    files.write_partitioned(log.filter("event_date = '2026-07-02'"), path, keep_others=False)
    assert {r["event_date"] for r in files.read_event_log(spark, path).collect()} == {"2026-07-02"}


def test_a_large_day_is_split_into_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 200_000, 1, 8).select(
            F.sha2(F.col("id").cast("string"), 256).alias("text"),
            F.when(F.col("id") % 3 == 0, "2026-07-01")
            .otherwise(F.concat(F.lit("2026-08-"), F.lpad((F.col("id") % 20 + 1).cast("string"), 2, "0")))
            .alias("event_date"),
        )
        files.write_partitioned(rows, f"{tmp_path}/days")
        assert len(glob.glob(f"{tmp_path}/days/event_date=2026-07-01/*.parquet")) > 4
        assert spark.read.parquet(f"{tmp_path}/days").count() == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_read_or_empty(spark, log, tmp_path):
    empty = files.read_or_empty(spark, f"{tmp_path}/absent", schemas.EVENT_LOG)
    assert empty.columns == schemas.EVENT_LOG.names and empty.count() == 0
    files.write_table(log, f"{tmp_path}/log")
    assert files.read_or_empty(spark, f"{tmp_path}/log", schemas.EVENT_LOG).count() == len(EVENTS)


def test_conforming_read(spark, tmp_path):
    wide = spark.sql(
        "SELECT '20260701' AS date_key, '2026-07-01' AS date_str, 2026L AS year, 7L AS month, 1L AS day, "
        "27L AS week_of_year, 3L AS day_of_week, 0L AS is_weekend, 1L AS is_holiday, 'x' AS extra"
    )
    files.write_table(wide, f"{tmp_path}/dim_date")
    got = files.read_table(spark, f"{tmp_path}/dim_date", schemas.DIM_DATE, conform=True)
    assert dict(got.dtypes)["year"] == "int" and got.columns == schemas.DIM_DATE.names
    with pytest.raises(ValueError, match="register_time"):
        files.read_table(spark, f"{tmp_path}/dim_date", schemas.DIM_USER, conform=True)


def test_csv_round_trip(spark, tmp_path):
    df = spark.sql(
        """SELECT * FROM VALUES
             (1L, 'a,"b"', timestamp_ntz'2026-07-01 10:00:00.123456', date'2026-07-01', 0.1D, true),
             (2L, CAST(NULL AS STRING), CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS DATE), CAST(NULL AS DOUBLE), false)
           AS t(id, text, at, day, x, flag)"""
    )
    files.export_tables_csv({"t": df}, str(tmp_path))
    assert collect(files.read_csv(spark, f"{tmp_path}/t", df.schema)) == collect(df)


def test_csv_keeps_text(spark, tmp_path):
    values = [" lead", "trail ", "", None, "line1\nline2", "cr\rx", "a\r\nb", '"', 'q"q', "back\\slash", "\\", "a,b", " "]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, text string")
    files.export_csv(df, f"{tmp_path}/t")
    got = files.read_csv(spark, f"{tmp_path}/t", df.schema)
    assert [r["text"] for r in got.orderBy("id").collect()] == values


def test_catalog(spark, log, tmp_path):
    current = spark.catalog.currentDatabase()
    for name, df in {
        "dim_user": users(spark, "u1"), "dim_task": tasks(spark, *TASKS),
        "dim_date": spark.createDataFrame([], schemas.DIM_DATE),
    }.items():
        files.write_table(df, f"{tmp_path}/{name}")
    files.write_partitioned(log, f"{tmp_path}/ods_todo_event_log")
    try:
        catalog.register_raw_layer(spark, "daybook_test", str(tmp_path))
        tables = {r["tableName"] for r in catalog.list_tables(spark).collect() if not r["isTemporary"]}
        assert tables == set(schemas.TABLES)
        assert [r[0] for r in catalog.list_partitions(spark, "ods_todo_event_log").collect()] == [
            "event_date=2026-07-01", "event_date=2026-07-02", "event_date=2026-07-03",
        ]
        table = spark.table("ods_todo_event_log")
        assert dict(table.dtypes)["event_date"] == "string"
        assert table.count() == len(EVENTS)
        # before the repair a partitioned table shows no rows
        catalog.drop_tables(spark, "ods_todo_event_log")
        catalog.create_partitioned_table(
            spark, "ods_todo_event_log", schemas.EVENT_LOG, f"{tmp_path}/ods_todo_event_log"
        )
        assert spark.table("ods_todo_event_log").count() == 0
        catalog.repair_partitions(spark, "ods_todo_event_log")
        assert spark.table("ods_todo_event_log").count() == len(EVENTS)
    finally:
        spark.catalog.setCurrentDatabase(current)
        spark.sql("DROP DATABASE IF EXISTS daybook_test CASCADE")


def raw_folder(spark, log, path):
    files.write_table(users(spark, "u1", "u2", user_group="old_user", register_channel="web"), f"{path}/dim_user")
    files.write_table(tasks(spark, *TASKS), f"{path}/dim_task")
    files.write_partitioned(log, f"{path}/ods_todo_event_log")
    return str(path)


def test_pipeline(spark, log, tmp_path):
    folder = raw_folder(spark, log, f"{tmp_path}/raw")
    tables = layers.run(spark, folder, f"{tmp_path}/out")
    assert tables["event_raw"].count() == len(EVENTS)
    assert tables["dwd_todo_event_detail"].columns == list(detail.FACT_ORDER)
    assert len(tables) == 5 + 9 + 26
    # what was stored equals what the lazy layers give
    raw = layers.read_raw(spark, folder)
    lazy = layers.detail_layer(raw)
    sums = layers.summary_layer(raw, lazy)
    for name, df in {**lazy, **sums, **layers.metric_layer(raw, lazy, sums)}.items():
        assert collect(tables[name]) == collect(df), name
    assert spark.table("dws_user_active_1d").count() == tables["dws_user_active_1d"].count()
    again = layers.run(spark, folder, f"{tmp_path}/out", copies=True)
    assert collect(again["dwd_todo_event_detail"]) == collect(lazy["dwd_todo_event_detail"])
    assert os.path.isdir(f"{tmp_path}/out/detail/dwd_todo_event_detail/event_date=2026-07-01")


def test_new_days_are_added(spark, log, tmp_path):
    """A run of one more day equals a run of all days."""
    early = log.filter("event_date < '2026-07-03'")
    folder, out = raw_folder(spark, early, f"{tmp_path}/raw"), f"{tmp_path}/out"
    assert layers.run(spark, folder, out)["event_raw"].count() == 6
    files.write_partitioned(log.filter("event_date = '2026-07-03'"), f"{folder}/ods_todo_event_log")
    tables = layers.run(spark, folder, out, days=("2026-07-03", "2026-07-03"))
    full = layers.detail_layer(layers.read_raw(spark, folder))
    for name in ("event_raw", "dwd_task_lifecycle", "dwd_user_active_detail"):
        assert collect(tables[name]) == collect(full[name])


def test_late_events_and_emptied_days(spark, log, tmp_path):
    """A run of some days equals a full run where a directory holds events of other
    days, and where a day has no events left."""
    folder, out = raw_folder(spark, log, f"{tmp_path}/raw"), f"{tmp_path}/out"
    layers.run(spark, folder, out)
    # The directory of the second day now holds a copy of the first day's events too.
    late = log.filter("event_date <= '2026-07-02'").withColumn("event_date", F.lit("2026-07-02"))
    files.write_partitioned(late, f"{folder}/ods_todo_event_log")
    tables = layers.run(spark, folder, out, days=("2026-07-02", "2026-07-02"))
    full = layers.detail_layer(layers.read_raw(spark, folder))["event_raw"]
    assert collect(tables["event_raw"]) == collect(full)
    # The last day's events are gone.
    rest = f"{tmp_path}/rest"
    raw_folder(spark, log.filter("event_date < '2026-07-03'"), rest)
    tables = layers.run(spark, rest, out, days=("2026-07-03", "2026-07-03"))
    full = layers.detail_layer(layers.read_raw(spark, rest))["event_raw"]
    assert collect(tables["event_raw"]) == collect(full)


def test_changed_rows_of_other_days(spark, log, tmp_path, monkeypatch):
    """A run of one day equals a full run where, of other days, a task or a user has
    changed since, or an event was corrected."""
    for later in ("summary_layer", "metric_layer"):  # only the detail layer is stored by day
        monkeypatch.setattr(layers, later, lambda *args: {})
    folder, out = raw_folder(spark, log, f"{tmp_path}/raw"), f"{tmp_path}/out"
    layers.run(spark, folder, out)

    def check():
        tables = layers.run(spark, folder, out, days=("2026-07-03", "2026-07-03"))
        full = layers.detail_layer(layers.read_raw(spark, folder))["event_raw"]
        assert collect(tables["event_raw"]) == collect(full)

    changed = [t | {"task_status": "open", "is_completed": False} if t["task_id"] == "t1" else t for t in TASKS]
    files.write_table(tasks(spark, *changed), f"{folder}/dim_task")
    check()
    # A value goes from one column to another that was NULL.
    for column in ("province", "city"):
        files.write_table(users(spark, "u1", "u2", **{column: "X"}), f"{folder}/dim_user")
        check()
    kind = F.when(F.col("log_id") == "e2", "edit_task").otherwise(F.col("event_type"))
    files.write_partitioned(
        log.filter("event_date = '2026-07-01'").withColumn("event_type", kind), f"{folder}/ods_todo_event_log"
    )
    check()


def test_checks(spark, log, tmp_path):
    raw = layers.read_raw(spark, raw_folder(spark, log, f"{tmp_path}/raw"))
    reports = layers.check(raw)
    assert dict(collect(reports["row_counts"]))["ods_todo_event_log"] == len(EVENTS)
    assert dict(collect(reports["orphan_events"])) == {
        "unknown_user": 2, "unknown_task": 1, "outside_period": 0,
    }
    report = reports["schema_report"].filter("table_name = 'dim_task'")
    assert report.filter("NOT matches").count() == 0
    assert report.filter("column_name = 'due_date'").first()["null_cnt"] == 1
    assert reports["duplicate_log_ids"].count() == 0


def test_schema_report_names_differences(rows):
    frame = rows("user_id bigint, extra string", (1, None))
    out = {
        r["column_name"]: (r["data_type"], r["expected_type"], r["matches"], r["null_cnt"])
        for r in quality.schema_report({"dim_user": frame}, {"dim_user": schemas.columns("user_id string, city string")}).collect()
    }
    assert out == {
        "user_id": ("bigint", "string", False, 0), "extra": ("string", None, False, 1),
        "city": (None, "string", False, None),
    }


@pytest.mark.parametrize(
    "options", [{}, {"broadcast_bytes": -1, "rows_per_split": 1}]
)
def test_duplicates(rows, options):
    frame = rows("k string, t int", ("a", 2), ("b", 1), ("a", 1), (None, 4), (None, 3), ("", 5))
    out = quality.duplicates(frame, "k", ["t"], spread="t", **options)
    assert [tuple(r) for r in out.collect()] == [(None, 3), (None, 4), ("a", 1), ("a", 2)]


def test_shuffles_are_sized_by_the_sources(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        monkeypatch.setattr(session, "source_bytes", lambda df: 40 * session.PARTITION_BYTES)
        assert session.size_shuffles(spark, spark.range(1), spark.range(1)) == 80
        monkeypatch.setattr(session, "source_bytes", lambda df: 1)
        assert session.size_shuffles(spark, spark.range(1)) == 80
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_guards(rows):
    frame = rows("x int", (1,), (2,))
    assert quality.require_row_count(frame, 1, 2) == 2
    with pytest.raises(ValueError, match="expected 3 to 9"):
        quality.require_row_count(frame, 3, 9)
    assert quality.require_parts_within(5, {"a": frame, "b": frame}) == 1
    with pytest.raises(ValueError, match="total is 3"):
        quality.require_parts_within(3, {"a": frame, "b": frame})


def test_run_statistics(spark, log):
    events = detail.typed_events(log)
    row = quality.run_metrics(users(spark, "u1", "u2"), tasks(spark, *TASKS), events).first()
    assert tuple(row) == (2, 3, 1.0, 0.5, 7 / 6)
    ratios = {r[0]: r[1] for r in quality.null_ratios(events, ["task_id", "user_id"]).collect()}
    assert ratios == {"task_id": pytest.approx(2 / 7), "user_id": 0.0}
    top = [tuple(r) for r in quality.top_event_types(events, 2).collect()]
    assert top == [("app_launch", 2), ("create_task", 2)]
    shares = dict(collect(quality.event_type_distribution(events)))
    assert shares["app_launch"] == 0.2857
    assert dict(collect(quality.value_counts(events, "task_id")))[None] == 2
    late = quality.orphan_events(
        events, users(spark, "u1"), tasks(spark, *TASKS), F.lit(dt.date(2026, 7, 2)), F.lit(dt.date(2026, 7, 2))
    )
    assert dict(collect(late)) == {"unknown_user": 4, "unknown_task": 1, "outside_period": 3}
