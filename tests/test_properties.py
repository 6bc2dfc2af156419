"""Relations between the tables of the sample data."""

import os

import pytest
from pyspark.sql import functions as F

from daybook.plans.registry import QUERIES
from daybook.sources import sample_tables as st

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables absent")


@pytest.fixture
def table(spark):
    return lambda name: QUERIES[name](spark, FOLDER)


def test_new_and_old_users_make_up_the_active(table):
    split = {r["date"]: r["new_user_cnt"] + r["old_user_cnt"] for r in table("new_old_structure").collect()}
    assert split == {r["date"]: r["dau"] for r in table("dau").collect()}


def test_wider_windows_hold_more_users(table):
    assert table("wau_mau").filter("dau > wau OR wau > mau").count() == 0


def test_retained_users_are_part_of_the_cohort(table):
    cohorts = table("dws_user_retain_summary")
    assert cohorts.filter(
        "greatest(day1_retained_users, day7_retained_users, day30_retained_users) > total_new_users"
    ).count() == 0


def test_totals_agree(table):
    def total(name):
        return table(name).agg(F.sum("event_cnt")).first()[0]

    assert total("dws_hour_active_summary") == total("dws_event_type_summary_1d")
    assert total("dws_channel_region_summary") == total("dws_event_type_summary_1d")
    assert total("dws_user_active_1d") == total("dwd_user_active_detail") == total("dws_hour_active_summary")


def test_retention_reaches_day_30_in_many_cohorts(table):
    cohorts = table("dws_user_retain_summary")
    assert cohorts.count() > 2 and cohorts.filter("day30_retained_users > 0").count() > 0


def test_joins_keep_one_row_per_event(spark, table):
    assert table("event_raw").count() == st.event_log(spark, FOLDER).count()


def test_funnel_and_milestones(table):
    steps = {r["step"]: r["task_cnt"] for r in table("task_funnel").collect()}
    assert steps["completed"] <= steps["created"] and steps["postponed"] == 0
    created = table("milestone_events").filter("event_type = 'create_task'").count()
    assert created == steps["created"]
