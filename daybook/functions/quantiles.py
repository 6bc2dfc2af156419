"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(
    df: DataFrame, group: str, value: str, quantiles: Mapping[str, float], bucket_width: int
) -> DataFrame:
    """Linearly interpolated quantiles of an integer column, one row per group.

    Values are first counted per (group, value). Bucket totals then place every
    bucket in the group's order, and a running count inside each bucket gives
    each distinct value its range of ranks. A window holds the buckets of one
    group or the distinct values of one bucket, never the rows of a group.
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    per_value = (
        rows.groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.floor(F.col(value) / bucket_width))
    )
    by_bucket = Window.partitionBy(group).orderBy("bucket")
    buckets = (
        per_value.groupBy(group, "bucket")
        .agg(F.sum("n").alias("bucket_n"))
        .withColumn("total", F.sum("bucket_n").over(Window.partitionBy(group)))
        .withColumn("before", F.sum("bucket_n").over(by_bucket) - F.col("bucket_n"))
    )
    in_bucket = Window.partitionBy(group, "bucket").orderBy(value)
    ranked = (
        per_value.withColumn("upto", F.sum("n").over(in_bucket))
        .join(buckets, [group, "bucket"])
        .withColumn("last_rank", F.col("before") + F.col("upto") - 1)
        .withColumn("first_rank", F.col("last_rank") - F.col("n") + 1)
    )

    def at_rank(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("first_rank"), F.col("last_rank")), F.col(value)))

    columns = []
    for name, q in quantiles.items():
        position = (F.col("total") - 1) * F.lit(float(q))
        low = at_rank(F.floor(position)).cast("double")
        high = at_rank(F.ceil(position)).cast("double")
        share = F.max(position - F.floor(position))
        columns.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(group).agg(F.max("total").alias("n"), *columns)
