"""Runs of some days read what has changed, and give what a full run gives."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from daybook.operators import detail
from daybook.plans import layers
from daybook.sources import files
from tests.helpers import collect, event_log, tasks, users
from tests.test_layers import EVENTS, TASKS


@pytest.fixture
def folders(spark, tmp_path, monkeypatch):
    """A raw folder that was built once; only the detail layer is of interest."""
    for later in ("summary_layer", "metric_layer"):
        monkeypatch.setattr(layers, later, lambda *args: {})
    raw, out = f"{tmp_path}/raw", f"{tmp_path}/out"
    files.write_table(users(spark, "u1", "u2", user_group="old_user"), f"{raw}/dim_user")
    files.write_table(tasks(spark, *TASKS), f"{raw}/dim_task")
    log = event_log(spark, *EVENTS).withColumn("event_date", F.substring("event_time", 1, 10))
    files.write_partitioned(log, f"{raw}/ods_todo_event_log")
    layers.run(spark, raw, out)
    return raw, out, log


def check(spark, raw, out, days=("2026-07-03", "2026-07-03")):
    tables = layers.run(spark, raw, out, days=days)
    full = layers.detail_layer(layers.read_raw(spark, raw))
    for name in ("event_raw", "dwd_task_lifecycle", "dwd_user_active_detail"):
        assert collect(tables[name]) == collect(full[name]), name


def unreadable(raw, day):
    """Blank the rows of a day's files, with the same listing and footers."""
    folder = f"{raw}/ods_todo_event_log/event_date={day}"
    for file in os.listdir(folder):
        path = f"{folder}/{file}"
        if file.endswith(".crc"):
            os.remove(path)
        elif file.endswith(".parquet"):
            held = os.stat(path)
            with open(path, "r+b") as f:
                f.seek(held.st_size - 8)
                footer = int.from_bytes(f.read(4), "little") + 8
                f.seek(4)
                f.write(b"\0" * (held.st_size - footer - 4))
            os.utime(path, ns=(held.st_atime_ns, held.st_mtime_ns))


def test_other_days_are_not_read(spark, folders, tmp_path):
    raw, out, log = folders
    more = event_log(spark, ("e8", "u2", "s5", "2026-07-03 08:00:00", "create_task", "t3")).withColumn(
        "event_date", F.lit("2026-07-03")
    )
    third = log.filter("event_date = '2026-07-03'").unionByName(more)
    third.write.mode("overwrite").parquet(f"{tmp_path}/third")
    files.write_partitioned(spark.read.parquet(f"{tmp_path}/third"), f"{raw}/ods_todo_event_log")
    for day in ("2026-07-01", "2026-07-02"):
        unreadable(raw, day)
    tables = layers.run(spark, raw, out, days=("2026-07-03", "2026-07-03"))
    assert tables["event_raw"].count() == len(EVENTS) + 1
    assert tables["dwd_task_lifecycle"].filter("task_id = 't1'").count() == 2
    with pytest.raises(Exception):
        layers.read_raw(spark, raw)["ods_todo_event_log"].filter("event_date = '2026-07-01'").select("log_id").collect()


def test_nothing_changed(spark, folders):
    raw, out, _ = folders
    check(spark, raw, out, ("2026-08-01", "2026-08-02"))


def test_late_event_moves_from_one_day_to_another(spark, folders):
    raw, out, log = folders
    moved = F.when(F.col("log_id") == "e7", "2026-07-01 23:00:00").otherwise(F.col("event_time"))
    rows = log.filter("event_date = '2026-07-03'").unionByName(log.filter("log_id = 'e1'").withColumns(
        {"log_id": F.lit("e9"), "event_time": F.lit("2026-07-03 01:00:00"), "event_date": F.lit("2026-07-03")}
    ))
    files.write_partitioned(rows.withColumn("event_time", moved), f"{raw}/ods_todo_event_log")
    check(spark, raw, out)


def test_changed_dimension_rows_and_files_of_other_days(spark, folders):
    raw, out, log = folders
    changed = [t | {"task_status": "open"} if t["task_id"] == "t1" else t for t in TASKS]
    files.write_table(tasks(spark, *changed), f"{raw}/dim_task")
    check(spark, raw, out)
    files.write_table(users(spark, "u1", "u2", "ghost", province="X"), f"{raw}/dim_user")
    check(spark, raw, out)
    kind = F.when(F.col("log_id") == "e2", "edit_task").otherwise(F.col("event_type"))
    files.write_partitioned(
        log.filter("event_date = '2026-07-01'").withColumn("event_type", kind), f"{raw}/ods_todo_event_log"
    )
    check(spark, raw, out)


def test_a_day_that_is_gone(spark, folders):
    raw, out, log = folders
    rows = log.filter("event_date = '2026-07-03'").withColumn("event_time", F.lit("2026-07-02 10:00:00"))
    files.write_partitioned(rows, f"{raw}/ods_todo_event_log")
    check(spark, raw, out)
    days = {r[0] for r in spark.read.parquet(f"{out}/detail/event_raw").select("event_date").distinct().collect()}
    assert {str(d) for d in days} == {"2026-07-01", "2026-07-02"}


def test_a_failed_run_is_made_up_for(spark, folders, monkeypatch):
    raw, out, log = folders
    rows = log.filter("event_date = '2026-07-03'").withColumn("event_type", F.lit("edit_task"))
    files.write_partitioned(rows, f"{raw}/ods_todo_event_log")
    real = detail.lifecycle_of

    def stop(*args, **options):
        raise RuntimeError("stopped")

    monkeypatch.setattr(detail, "lifecycle_of", stop)
    with pytest.raises(RuntimeError):
        layers.run(spark, raw, out, days=("2026-07-03", "2026-07-03"))
    monkeypatch.setattr(detail, "lifecycle_of", real)
    check(spark, raw, out, ("2026-09-01", "2026-09-01"))


def test_lifecycles_from_days_equal_those_of_all_events(spark):
    events = detail.typed_events(event_log(spark, *EVENTS))
    parts = detail.lifecycle_stats(events, True, by=("event_date",))
    assert collect(detail.merged_stats(parts)) == collect(detail.lifecycle_stats(events, True))
    assert parts.filter(F.col("event_date") == dt.date(2026, 7, 2)).count() == 4
