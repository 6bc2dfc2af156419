"""Activity metrics: DAU/WAU/MAU, new and old users, frequency, retention, channels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.values import first_present, lenient_date, number_from_text, ratio
from daybook.operators.summary import active_days_since_first

WEEK_DAYS, MONTH_DAYS = 7, 30


def _dated(df: DataFrame, column: str, name: str = "date") -> DataFrame:
    """Rows with a readable date in ``column``, as ``name``."""
    return df.withColumn(name, lenient_date(df, column)).filter(F.col(name).isNotNull())


def dau(active: DataFrame) -> DataFrame:
    """Distinct users per day; rows without a readable date are dropped."""
    return _dated(active, "stat_date").groupBy("date").agg(F.count_distinct("user_id").alias("dau"))


def fill_days(daily: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Every calendar day from the first to the last; missing counts are 0."""
    spine = daily.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias(date)
    )
    return spine.join(daily, date, "left").select(
        date, *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in columns]
    )


def dau_filled(active: DataFrame) -> DataFrame:
    return fill_days(dau(active), ["dau"])


def activity_trend(
    active: DataFrame, windows: Mapping[str, int] | None = None
) -> DataFrame:
    """DAU and distinct users over trailing windows (WAU 7, MAU 30), every day.

    A user's active day covers the days until its window ends or the user's
    next active day, whichever is first. These intervals never overlap for one
    user, so the users in a window are a running sum of interval starts and
    ends per day: one shuffle by user, then at most two rows per calendar day.
    """
    windows = {"wau": WEEK_DAYS, "mau": MONTH_DAYS} if windows is None else windows
    dated = _dated(active, "stat_date")
    days = dated.filter(F.col("user_id").isNotNull()).select("user_id", "date").distinct()
    # Days on which only unknown users were active belong to the calendar as well.
    unknown = dated.filter(F.col("user_id").isNull() & F.col("date").isNotNull()).select("date").distinct()
    following = F.lead("date").over(Window.partitionBy("user_id").orderBy("date"))
    names = ["dau", *windows]

    def change(day: Column, **values: int) -> Column:
        return F.struct(
            day.alias("date"),
            (day == F.col("date")).alias("active"),
            *[F.lit(values.get(n, 0)).cast("bigint").alias(n) for n in names],
        )

    starts = change(F.col("date"), **dict.fromkeys(names, 1))
    ends = [
        change(F.least(F.date_add("date", n), F.col("following")), **{name: -1})
        for name, n in windows.items()
    ]
    changes = (
        days.withColumn("following", following)
        .select(F.inline(F.array(starts, *ends)))
        .unionByName(unknown.select(F.inline(F.array(change(F.col("date"))))))
        .groupBy("date")
        .agg(F.max("active").alias("active"), *[F.sum(n).alias(n) for n in names])
    )
    # At most one row per calendar day from here on. Each row stands for the days
    # up to the next change; ends after the last active day are dropped.
    in_order = Window.orderBy("date")
    last_day = F.max(F.when(F.col("active"), F.col("date"))).over(Window.partitionBy(F.lit(1)))
    held = changes.select(
        F.col("date").alias("start"),
        F.lead("date").over(in_order).alias("next_start"),
        last_day.alias("last_day"),
        "dau",
        *[F.sum(n).over(in_order).alias(n) for n in windows],
    ).filter("start <= last_day")
    end = F.least(F.date_sub("next_start", 1), F.col("last_day"))
    changed = F.col("date") == F.col("start")
    return held.select("*", F.explode(F.sequence(F.col("start"), end)).alias("date")).select(
        "date", F.when(changed, F.col("dau")).otherwise(F.lit(0)).alias("dau"), *windows
    )


def activity_kpis(trend: DataFrame, metrics: Sequence[str] = ("dau", "wau", "mau")) -> DataFrame:
    """Per metric: the last day's value and truncated 7- and 30-day means."""
    recent = trend.withColumn(
        "back", F.row_number().over(Window.orderBy(F.desc("date")))
    ).filter(F.col("back") <= MONTH_DAYS)
    long = recent.unpivot(["back"], list(metrics), "metric", "users")

    def mean_of(n: int) -> Column:
        return F.avg(F.when(F.col("back") <= n, F.col("users"))).cast("bigint")

    return long.groupBy("metric").agg(
        F.max(F.when(F.col("back") == 1, F.col("users"))).alias("today"),
        mean_of(WEEK_DAYS).alias("avg_7d"),
        mean_of(MONTH_DAYS).alias("avg_30d"),
    )


def new_old_structure(new_old: DataFrame) -> DataFrame:
    """New and old users per readable day, in date order."""
    return _dated(new_old, "stat_date").select("date", "new_user_cnt", "old_user_cnt").orderBy("date")


def new_old_share(new_old: DataFrame, day: str | None = None) -> DataFrame:
    """One day's new and old users and their percentages (default: the last day)."""
    dated = _dated(new_old, "stat_date")
    wanted = (
        F.lit(day).cast("date") if day is not None else dated.agg(F.max("date").alias("d")).scalar()
    )
    total = F.col("new_user_cnt") + F.col("old_user_cnt")
    return dated.filter(F.col("date") == wanted).select(
        "date",
        F.col("new_user_cnt").cast("bigint").alias("new_user_cnt"),
        F.col("old_user_cnt").cast("bigint").alias("old_user_cnt"),
        (ratio(F.col("new_user_cnt"), total) * 100).alias("new_pct"),
        (ratio(F.col("old_user_cnt"), total) * 100).alias("old_pct"),
    )


# Lowest active-day count of each frequency bucket.
HIGH_DAYS, MEDIUM_DAYS = 15, 5
BUCKET_LABELS = {
    "high": "high", "medium": "medium", "low": "low", "none": "none", "unknown": "unknown",
}


def frequency_bucket(days: Column, labels: Mapping[str, str] = BUCKET_LABELS) -> Column:
    return (
        F.when(days.isNull(), labels["unknown"])
        .when(days >= HIGH_DAYS, labels["high"])
        .when(days >= MEDIUM_DAYS, labels["medium"])
        .when(days > 0, labels["low"])
        .otherwise(labels["none"])
    )


def activity_frequency(
    behavior: DataFrame, labels: Mapping[str, str] = BUCKET_LABELS
) -> DataFrame:
    """Distinct users per last active day and frequency bucket."""
    days = number_from_text(F.col("active_day_cnt").cast("string"))
    return (
        _dated(behavior, "last_active_date")
        .withColumn("freq_bucket", frequency_bucket(days, labels))
        .groupBy("date", "freq_bucket")
        .agg(F.count_distinct("user_id").alias("cnt"))
    )


def active_share(behavior: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Users with at least one active day against all others.

    All users are those of ``behavior`` (so none is inactive), or of ``base``.
    """
    rows = _dated(behavior, "last_active_date")
    days = number_from_text(F.col("active_day_cnt").cast("string"))
    counted = rows.groupBy("user_id").agg(
        F.coalesce(F.max((days > 0).cast("int")), F.lit(0)).alias("active"), F.lit(1).alias("known")
    )
    if base is not None:
        others = base.select("user_id", F.lit(0).alias("active"), F.lit(1).alias("known"))
        counted = (
            counted.unionByName(others)
            .groupBy("user_id")
            .agg(F.max("active").alias("active"), F.max("known").alias("known"))
        )
    totals = counted.filter(F.col("user_id").isNotNull()).agg(
        F.coalesce(F.sum("active"), F.lit(0)).alias("active"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("total"),
    )
    return totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("active").alias("label"), F.col("active").alias("cnt")),
                F.struct(
                    F.lit("inactive").alias("label"),
                    F.greatest(F.col("total") - F.col("active"), F.lit(0).cast("bigint")).alias(
                        "cnt"
                    ),
                ),
            )
        )
    )


RATE_PERIODS = ("retain_1d", "retain_7d", "retain_30d")


def retention_rates(retain: DataFrame) -> DataFrame:
    """Cohorts with retained users over cohort size; an empty cohort gives NULL.

    Rates already present are kept.
    """
    dated = _dated(retain, "first_active_date")
    if set(RATE_PERIODS) <= set(dated.columns):
        return dated
    rates = {
        f"retain_{n}d": ratio(F.col(f"day{n}_retained_users"), F.col("total_new_users"))
        for n in (1, 7, 30)
        if f"day{n}_retained_users" in dated.columns
    }
    return dated.withColumns(rates)


def retention_long(rates: DataFrame) -> DataFrame:
    """One row per cohort day and period."""
    return rates.unpivot(["date"], list(RATE_PERIODS), "period", "rate")


def retention_curve(active: DataFrame) -> DataFrame:
    """Share of each cohort active n days after its first day, for every n seen."""
    counts = (
        active_days_since_first(active.filter(F.col("user_id").isNotNull()))
        .groupBy(F.col("first_active_date").alias("cohort_date"), "day_index")
        .agg(F.count(F.lit(1)).alias("users"))
    )
    # One row per cohort day and day index from here on.
    size = F.max(F.when(F.col("day_index") == 0, F.col("users"))).over(
        Window.partitionBy("cohort_date")
    )
    return counts.select(
        "cohort_date", "day_index", "users", ratio(F.col("users"), size).alias("retain_rate")
    )


def cohort_matrix(curve: DataFrame, day_indexes: Sequence[int] | None = None) -> DataFrame:
    """Cohort day × day index → mean retention. Every cell of the curve as a row
    ``cohort_date, day_index, retain_rate``; with ``day_indexes`` those days as columns
    ``day_<n>``, for a page that shows a range of them."""
    if day_indexes is None:
        return curve.groupBy("cohort_date", "day_index").agg(F.avg("retain_rate").alias("retain_rate"))
    wide = curve.filter(F.col("day_index").isin(list(day_indexes))).groupBy("cohort_date")
    matrix = wide.pivot("day_index", list(day_indexes)).agg(F.avg("retain_rate"))
    cohorts = curve.select("cohort_date").distinct()
    return cohorts.join(matrix, "cohort_date", "left").select(
        "cohort_date", *[F.col(f"`{n}`").alias(f"day_{n}") for n in day_indexes]
    )


def cohort_bands(curve: DataFrame, width: int) -> DataFrame:
    """The whole matrix, cohort day × day index → mean retention, cut into bands of
    ``width`` day indexes: a row for each cohort and band in which it has a cell, with the
    band's ``first_day_index`` and ``day_<n>``, the cell of day index ``first_day_index + n``
    (NULL where the cohort has none). The columns do not grow with the days of the data."""
    place = F.pmod("day_index", F.lit(width))
    placed = curve.withColumn("first_day_index", F.col("day_index") - place).withColumn("place", place)
    matrix = placed.groupBy("cohort_date", "first_day_index").pivot("place", list(range(width))).agg(F.avg("retain_rate"))
    return matrix.select(
        "cohort_date", "first_day_index", *[F.col(f"`{n}`").alias(f"day_{n}") for n in range(width)]
    )


# The same kinds as comparisons, which Catalyst takes as selective.
KIND_FILTERS = {
    "holiday": "is_holiday <=> 1",
    "weekend": "NOT (is_holiday <=> 1) AND is_weekend <=> 1",
    "workday": "NOT (is_holiday <=> 1) AND NOT (is_weekend <=> 1)",
}


def day_kind(calendar: DataFrame) -> DataFrame:
    """``date, kind`` of a calendar's days: holiday, weekend or workday."""
    kind = F.when(F.col("is_holiday") == 1, "holiday").when(F.col("is_weekend") == 1, "weekend").otherwise("workday")
    return calendar.select(F.col("date_str").cast("date").alias("date"), kind.alias("kind"))


def activity_by_day_kind(daily: DataFrame, calendar: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Days, total and mean per day of each of ``measures`` by kind of day.

    ``daily`` has one row per ``date``; days of the calendar that it lacks count as 0.
    """
    days = day_kind(calendar).join(daily, "date", "left")
    return days.groupBy("kind").agg(
        F.count(F.lit(1)).alias("day_cnt"),
        *[F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(f"{m}_total") for m in measures],
        *[F.avg(F.coalesce(F.col(m), F.lit(0))).alias(f"{m}_per_day") for m in measures],
    )


def of_day_kind(events: DataFrame, calendar: DataFrame, kind: str, partition: str = "event_date") -> DataFrame:
    """The events of a day-partitioned table on days of one kind. The days are looked up in
    the calendar, of one row per day, while the query runs, and only their partitions
    are read."""
    days = calendar.filter(KIND_FILTERS[kind]).select(
        F.col("date_str").cast("date").cast("string").alias("_day")
    )
    return events.join(F.broadcast(days), F.col(partition) == F.col("_day"), "left_semi")


# Accepted column names, the first present is used.
CHANNEL_NAMES = ("register_channel", "channel", "reg_channel")
COUNT_NAMES = (
    "new_user_cnt", "new_users", "new_register_cnt", "register_cnt", "new_registers",
    "active_user_cnt", "event_cnt",
)
MISSING_LABEL = "None"


def _channels(df: DataFrame) -> DataFrame:
    channel, count = first_present(df, CHANNEL_NAMES), first_present(df, COUNT_NAMES)
    if channel is None or count is None:
        raise ValueError("no channel or count column")
    label = F.trim(F.coalesce(F.col(channel).cast("string"), F.lit(MISSING_LABEL)))
    others = [c for c in df.columns if c not in (channel, count, "channel", "new_user_cnt")]
    return df.select(*others, label.alias("channel"), F.col(count).alias("new_user_cnt"))


def channel_totals(channels: DataFrame) -> DataFrame:
    """Sum of the chosen count per channel."""
    return _channels(channels).groupBy("channel").agg(F.sum("new_user_cnt").alias("new_user_cnt"))


def channel_region_totals(channels: DataFrame) -> DataFrame:
    """Sum per channel and province (city where there is no province column)."""
    region = first_present(channels, ("province", "city"))
    if region is None:
        return channel_totals(channels)
    return (
        _channels(channels)
        .filter(F.col(region).isNotNull())
        .groupBy("channel", region)
        .agg(F.sum("new_user_cnt").alias("new_user_cnt"))
    )


def channel_quality(channels: DataFrame, retention: DataFrame) -> DataFrame:
    """Channel volume with the mean 7-day retention of the channel's cohorts."""
    by_channel = retention.groupBy("channel").agg(F.avg("retain_7d").alias("retain_7d"))
    return channel_totals(channels).join(by_channel, "channel", "left")
