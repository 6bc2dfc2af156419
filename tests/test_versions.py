"""Named tables replaced whole."""

import uuid

import pytest
from pyspark.sql import functions as F

from daybook.plans import layers
from daybook.sources import catalog, versions


@pytest.fixture
def name(spark, tmp_path):
    database, current = f"versions_{uuid.uuid4().hex[:8]}", spark.catalog.currentDatabase()
    catalog.ensure_database(spark, database, str(tmp_path))
    spark.catalog.setCurrentDatabase(current)
    yield f"{database}.numbers"
    spark.sql(f"DROP DATABASE {database} CASCADE")


def numbers(spark, n):
    return spark.range(n).withColumn("part", (F.col("id") % 2).cast("string"))


def test_a_failed_build_leaves_the_old_rows(spark, name):
    versions.replace_table(numbers(spark, 5), name)
    broken = numbers(spark, 100).withColumn("id", F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("stop"))))
    with pytest.raises(Exception, match="stop"):
        versions.replace_table(broken.repartition(4), name)
    assert spark.table(name).count() == 5
    assert versions.current_version(spark, name) == 1
    # The next build is not hindered by what the failed one left behind.
    assert versions.replace_table(numbers(spark, 7), name) == 2
    assert spark.table(name).count() == 7


def test_a_reader_finishes_on_the_version_it_began_on(spark, name):
    versions.replace_table(numbers(spark, 5), name)
    begun = spark.table(name)
    versions.replace_table(numbers(spark, 9), name)
    assert begun.count() == 5 and spark.table(name).count() == 9


def test_columns_and_partitions_may_change(spark, name):
    versions.replace_table(numbers(spark, 5), name, keep=3)
    versions.replace_table(spark.table(name).withColumn("twice", F.col("id") * 2), name, partition=["part"], keep=3)
    assert set(spark.table(name).columns) == {"id", "part", "twice"}
    assert spark.table(name).agg(F.sum("twice")).first()[0] == 20
    plan = spark.table(name).filter("part = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    versions.restore_version(spark, name, 1)
    assert spark.table(name).columns == ["id", "part"]
    rows = {r.version: (r.is_current, r.row_cnt) for r in versions.list_versions(spark, name).collect()}
    assert rows == {1: (True, 5), 2: (False, 5)}


def test_old_versions_go_but_never_the_one_shown(spark, name, tmp_path):
    for n in range(1, 5):
        assert versions.replace_table(numbers(spark, n), name) == n
    assert [r.version for r in versions.list_versions(spark, name).collect()] == [3, 4]
    assert len([d for d in tmp_path.iterdir() if "__v" in d.name]) == 2
    versions.restore_version(spark, name, 3)
    assert versions.drop_versions(spark, name, 1) == []
    assert versions.replace_table(numbers(spark, 9), name, keep=1) == 5
    assert [r.version for r in versions.list_versions(spark, name).collect()] == [5]


def test_a_name_of_something_else_is_refused(spark, name):
    numbers(spark, 3).write.saveAsTable(name)
    with pytest.raises(ValueError, match="not a versioned table"):
        versions.replace_table(numbers(spark, 5), name)
    assert spark.table(name).count() == 3


def test_publish_database(spark, name):
    database = name.partition(".")[0]
    frames = {"one": numbers(spark, 1), "two": numbers(spark, 2)}
    assert layers.publish_database(frames, database) == {"one": 1, "two": 1}
    assert layers.publish_database(frames, database) == {"one": 2, "two": 2}
    assert spark.table(f"{database}.two").count() == 2
