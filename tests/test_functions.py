import datetime as dt

import pytest
from pyspark.sql import functions as F

from daybook.functions import lookups, quantiles, times, values
from tests.helpers import collect

DAY = dt.date


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_soft_integer(rows):
    df = rows("t string", ("12.5",), ("abc",), (" 7 ",), ("1d",), (None,), ("9999999999",), ("-3",))
    assert column(df, values.soft_int(F.col("t"))) == [13, None, 7, None, None, None, -3]


def test_soft_boolean(rows):
    df = rows("t string", ("true",), ("yes",), ("0",), ("maybe",), (None,))
    assert column(df, values.soft_bool(F.col("t"))) == [True, True, False, None, None]


def test_lenient_number(rows):
    df = rows("t string", ("12%",), (" 3.5 ",), ("x%",), ("1e2",), (None,), ("100%%",))
    got = column(df, values.lenient_number(df, "t"))
    assert got == [pytest.approx(0.12), 3.5, None, 100.0, None, 1.0]
    numbers = rows("t double", (2.0,), (float("nan"),), (None,))
    assert column(numbers, values.lenient_number(numbers, "t")) == [2.0, None, None]


def test_mixed_date_text(rows):
    df = rows("t string", ("20260701",), ("2026-07-01",), ("bad",), ("2026-13-40",), (None,))
    day = DAY(2026, 7, 1)
    assert column(df, values.lenient_date(df, "t")) == [day, day, None, None, None]
    numbers = rows("t int", (20260701,), (5,), (None,))
    assert column(numbers, values.lenient_date(numbers, "t")) == [day, None, None]


def test_flags(rows):
    text = rows("t string", ("1",), ("0",), ("true",), (None,), ("2.5",))
    assert column(text, values.flag(text, "t")) == [1, 0, 0, 0, 1]
    booleans = rows("t boolean", (True,), (False,), (None,))
    assert column(booleans, values.flag(booleans, "t")) == [1, 0, 0]
    numbers = rows("t double", (0.0,), (3.0,), (float("nan"),))
    assert column(numbers, values.flag(numbers, "t")) == [0, 1, 0]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_arithmetic_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.sql(
            """SELECT timestamp_ntz'2024-03-10 01:30:00' AS a, timestamp_ntz'2024-03-10 03:30:00' AS b,
                      timestamp_ntz'2024-01-01 00:00:00.9' AS c, timestamp_ntz'2024-01-01 00:00:02.1' AS d,
                      timestamp_ntz'1969-12-31 23:59:58.5' AS e"""
        ).select(
            times.second_diff(F.col("a"), F.col("b")),
            times.second_diff(F.col("c"), F.col("d")),
            times.epoch_seconds(F.col("e")),
            times.time_slot(F.col("e"), 1800),
        )
        assert tuple(row.first()) == (7200, 2, -2, -1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


FACTS = [(f"e{i}", "hot" if i % 3 == 0 else (None if i % 3 == 1 else f"k{i % 50}")) for i in range(600)]
DIM = [("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)]


@pytest.mark.parametrize(
    "options",
    [
        {"broadcast_bytes": 1 << 62},
        {"broadcast_bytes": -1},
        {"broadcast_bytes": -1, "rows_per_split": 20},
    ],
    ids=["broadcast", "plain", "salted"],
)
def test_lookup_join_plans_agree(spark, options):
    fact = spark.createDataFrame(FACTS, "id string, k string")
    dim = spark.createDataFrame(DIM, "k string, v int")
    wanted = dict(DIM)
    got = lookups.lookup_join(fact, dim, "k", spread="id", **options)
    assert collect(got.select("id", "k", "v")) == sorted(
        (i, k, wanted.get(k)) for i, k in FACTS
    )


def test_lookup_join_splits_a_hot_key(spark):
    """No join task holds a key that has a third of the rows, nor the NULL keys."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = spark.createDataFrame(FACTS * 20, "id string, k string").withColumn(
            "id", F.concat("id", F.lit("-"), F.monotonically_increasing_id())
        )
        dim = spark.createDataFrame(DIM, "k string, v int")
        joined = lookups.lookup_join(
            fact, dim, "k", spread="id", broadcast_bytes=-1, rows_per_split=100
        )
        sizes = [
            r["n"]
            for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        ]
        assert sum(sizes) == len(FACTS) * 20
        assert max(sizes) < sum(sizes) / 5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [100, 1 << 40])
def test_a_fact_with_hot_keys_is_shuffled_once(spark, limit):
    """By key and salt, whether there are hot keys or not: their list is broadcast."""
    fact = spark.createDataFrame(FACTS * 20, "id string, k string")
    dim = spark.createDataFrame(DIM, "k string, v int")
    joined = lookups.lookup_join(fact, dim, "k", spread="id", broadcast_bytes=-1, rows_per_split=limit)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # One for each side.
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan
    assert ("BroadcastHashJoin" in plan) == (limit == 100)


def test_heavy_keys_are_counted_in_one_scan(spark, tmp_path):
    spark.createDataFrame([(str(n), n % 3, None if n % 2 else "x") for n in range(90)], "id string, a int, b string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    heavy = lookups.heavy_keys(df, ["a", "b"], 30)
    assert collect(heavy["a"]) == [] and collect(heavy["b"]) == [("x", 45)]
    assert collect(lookups.heavy_keys(df, ["a"], 29)["a"]) == [(0, 30), (1, 30), (2, 30)]
    assert heavy["a"].schema["a"].dataType == df.schema["a"].dataType and lookups.heavy_keys(df, [], 1) == {}


def test_keys_are_not_shuffled_to_find_that_none_is_heavy(spark, tmp_path):
    """Rows of a task combine by part of the keys, whatever the number of keys."""
    spark.range(300_000).selectExpr("id AS k", "id % 3 AS j").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert lookups.heavy_counts(df, ["k"], 1000)._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation <empty>")
    assert collect(lookups.heavy_counts(df, ["j"], 99_999)) == [(0, 100_000), (1, 100_000), (2, 100_000)]
    assert collect(lookups.heavy_keys(df.selectExpr("nullif(j, 1) AS j"), ["j"], 99_999, nulls=True)["j"], "j") == [
        (None, 100_000), (0, 100_000), (2, 100_000)
    ]


def test_exact_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [("a", int(x)) for x in rng.integers(0, 100_000, 501)]
    data += [("b", 7), ("b", 7), ("b", 8), ("c", 5), ("d", None)]
    df = spark.createDataFrame(data, "g string, x bigint")
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p99": 0.99, "hi": 1.0}
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, "g", "x", wanted, 3600).collect()}
    assert set(got) == {"a", "b", "c"}
    for group in got:
        values_ = [x for g, x in data if g == group]
        assert got[group]["n"] == len(values_)
        for name, q in wanted.items():
            assert got[group][name] == pytest.approx(float(np.quantile(values_, q)))


def test_source_size_counts_sources_once_and_columns_read(spark, tmp_path):
    path = f"{tmp_path}/wide"
    wide = spark.range(20_000).select("id", *[F.sha2(F.concat(F.col("id"), F.lit(i)), 256).alias(f"c{i}") for i in range(4)])
    wide.write.parquet(path)
    stored = spark.read.parquet(path)
    whole = lookups.source_bytes(stored)
    assert lookups.source_bytes(stored.select("id")) < whole / 3
    joined = stored.join(spark.read.parquet(path).withColumnRenamed("c0", "d0"), "id")
    assert lookups.source_bytes(joined) == 2 * whole
    assert lookups.source_bytes(spark.createDataFrame([(1,)], "id int")) > 1 << 40
    assert lookups.fits_broadcast(stored, whole) and not lookups.fits_broadcast(stored, whole - 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20m")
    try:
        assert lookups.broadcast_limit(stored) == 20 << 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
