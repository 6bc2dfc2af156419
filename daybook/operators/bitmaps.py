"""Sets of active users as stored bitmaps that windows of any length merge.

A day's users are bits in bitmaps of 32,768 users each. A bitmap of some days is the
bitwise OR of theirs, so distinct users of any window are exact and need neither the
log nor the list of active days.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.activity import MONTH_DAYS, WEEK_DAYS

# Buckets in which users are numbered independently of each other.
NUMBER_GROUPS = 4096


def number_users(active: DataFrame, known: DataFrame | None = None, user: str = "user_id") -> DataFrame:
    """``user, user_no``: a number from 1 on for each user, as bitmaps need them.

    Users in ``known`` (an earlier result) keep their numbers; new ones follow them.
    Users are numbered inside hash groups, and the groups' sizes, one row each, are added
    up, so no task sees all users. Numbers have no gaps as long as no user goes.
    """
    users = active.select(user).filter(F.col(user).isNotNull()).distinct()
    if known is not None:
        users = users.join(known.select(user), user, "left_anti")
        last = known.agg(F.coalesce(F.max("user_no"), F.lit(0)).alias("n")).scalar()
    else:
        last = F.lit(0).cast("bigint")
    grouped = users.withColumn("_group", F.pmod(F.xxhash64(user), F.lit(NUMBER_GROUPS)))
    sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "_group", (F.sum("_n").over(Window.orderBy("_group")) - F.col("_n")).alias("_before")
    )
    in_group = F.row_number().over(Window.partitionBy("_group").orderBy(user))
    numbered = grouped.join(F.broadcast(before), "_group").select(
        user, (last + F.col("_before") + in_group).cast("bigint").alias("user_no")
    )
    return numbered if known is None else known.select(user, "user_no").unionByName(numbered)


def daily_bitmaps(active: DataFrame, date: str = "stat_date", number: str = "user_no") -> DataFrame:
    """``date, bucket, users``: who was active on each day, a bitmap for each bucket of
    users. A day on which only unknown users (NULL numbers) were active has one row
    without a bitmap, so that the calendar stays whole."""
    known = active.filter(F.col(number).isNotNull() & F.col(date).isNotNull())
    return (
        known.groupBy(F.col(date).alias("date"), F.bitmap_bucket_number(F.col(number)).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number))).alias("users"))
        .unionByName(
            active.filter(F.col(number).isNull() & F.col(date).isNotNull())
            .select(F.col(date).alias("date"), F.lit(None).cast("bigint").alias("bucket"))
            .distinct()
            .withColumn("users", F.lit(None).cast("binary"))
        )
    )


def trailing_users(bitmaps: DataFrame, windows: Mapping[str, int] | None = None) -> DataFrame:
    """``date``, ``dau`` and the distinct users of trailing windows of days, for every day
    from the first to the last, from ``daily_bitmaps`` alone.

    The bitmaps of one bucket are ordered by day and merged over each window: a task holds
    the days of one bucket, 4 KB each. What is added up over the buckets is numbers.
    """
    windows = {"wau": WEEK_DAYS, "mau": MONTH_DAYS} if windows is None else windows
    number = F.datediff("date", F.lit("1970-01-01").cast("date"))
    bounds = bitmaps.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    last = bounds.select("hi").scalar()
    held = bitmaps.filter("users IS NOT NULL")
    # Windows end on days without activity too: a row for each day since the bucket's first.
    days = (
        held.groupBy("bucket").agg(F.min("date").alias("lo"))
        .select("bucket", F.explode(F.sequence(F.col("lo"), last)).alias("date"))
        .withColumn("users", F.lit(None).cast("binary"))
    )
    merged = held.select("bucket", "date", "users").unionByName(days).withColumn("_day", number)

    def size(n: int) -> Column:
        frame = Window.partitionBy("bucket").orderBy("_day").rangeBetween(1 - n, 0)
        return F.bitmap_count(F.bitmap_or_agg("users").over(frame))

    lengths = {"dau": 1, **windows}
    counted = merged.select("bucket", "date", *[size(n).alias(name) for name, n in lengths.items()])
    # The row of a day and the day's bitmap have the same windows: count one of them.
    once = counted.groupBy("bucket", "date").agg(*[F.max(name).alias(name) for name in lengths])
    totals = once.groupBy("date").agg(*[F.sum(name).alias(name) for name in lengths])
    calendar = bounds.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    return calendar.join(totals, "date", "left").select(
        "date", *[F.coalesce(F.col(n), F.lit(0).cast("bigint")).alias(n) for n in lengths]
    )


def period_users(bitmaps: DataFrame, period: Column, name: str = "period") -> DataFrame:
    """Distinct users of each ``period``, a column made of ``date``."""
    return (
        bitmaps.filter("users IS NOT NULL")
        .groupBy(period.alias(name), "bucket")
        .agg(F.bitmap_count(F.bitmap_or_agg("users")).alias("users"))
        .groupBy(name)
        .agg(F.sum("users").alias("users"))
    )


def kept_users(bitmaps: DataFrame, period: Column, name: str = "period") -> DataFrame:
    """Users of each ``period`` who were also active in the one before it, which ``period``
    numbers one less: a bitwise AND of the two unions, bucket by bucket."""
    union = (
        bitmaps.filter("users IS NOT NULL")
        .groupBy(period.alias(name), "bucket")
        .agg(F.bitmap_or_agg("users").alias("users"))
    )
    both = union.select("bucket", "users", F.explode(F.array(F.col(name), F.col(name) + 1)).alias(name))
    pairs = both.groupBy(name, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_and_agg("users")).alias("kept")
    )
    kept = pairs.groupBy(name).agg(F.sum(F.when(F.col("n") == 2, F.col("kept")).otherwise(0)).alias("kept_users"))
    totals = union.groupBy(name).agg(F.sum(F.bitmap_count("users")).alias("users"))
    return totals.join(kept, name, "left").select(name, "users", "kept_users")
