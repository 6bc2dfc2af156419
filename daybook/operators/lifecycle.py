"""Task metrics: completion totals and trend, priorities, durations, funnel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.lookups import lookup_join
from daybook.functions.quantiles import exact_quantiles
from daybook.functions.values import first_present, lenient_date, lenient_number, ratio
from daybook.session import scratch_path
from daybook.sources.files import publish

MISSING_PRIORITY = "None"


def completion_kpis(summary: DataFrame) -> DataFrame:
    """Totals, unweighted mean of the daily rates, truncated mean of daily means."""
    return summary.agg(
        F.coalesce(F.sum("task_created_cnt"), F.lit(0)).alias("total_created"),
        F.coalesce(F.sum("task_completed_cnt"), F.lit(0)).alias("total_completed"),
        F.coalesce(F.sum("overdue_cnt"), F.lit(0)).alias("total_overdue"),
        F.avg("completion_rate").alias("avg_completion_rate"),
        F.avg("avg_complete_duration_seconds").cast("bigint").alias("avg_duration_seconds"),
    )


def completion_trend(summary: DataFrame) -> DataFrame:
    """Created, completed and rate by readable day; unreadable numbers are 0."""
    def number(name: str, to: str) -> Column:
        return F.coalesce(lenient_number(summary, name), F.lit(0.0)).alias(to)

    return (
        summary.select(
            lenient_date(summary, "stat_date").alias("date"),
            number("task_created_cnt", "created"),
            number("task_completed_cnt", "completed"),
            number("completion_rate", "rate"),
        )
        .filter(F.col("date").isNotNull())
        .orderBy("date")
    )


def completion_overall(summary: DataFrame) -> DataFrame:
    """All completed over all created tasks in percent, 0 where none was created."""
    def total(*names: str) -> Column:
        name = first_present(summary, names)
        if name is None:
            return F.lit(0).cast("bigint")
        return F.coalesce(F.sum(lenient_number(summary, name)).cast("bigint"), F.lit(0))

    totals = summary.agg(
        total("task_created_cnt", "task_created").alias("total_created"),
        total("task_completed_cnt", "task_completed").alias("total_completed"),
    )
    rate = F.when(
        F.col("total_created") > 0,
        F.col("total_completed") / F.col("total_created").cast("double") * 100,
    ).otherwise(F.lit(0.0))
    return totals.withColumn("completion_pct", rate)


def priority_stats(lifecycle: DataFrame, missing: str = MISSING_PRIORITY) -> DataFrame:
    """Per priority: rows with a task, completed rows and overdue rows."""
    name = first_present(lifecycle, ("priority", "task_priority"))
    label = F.coalesce(F.col(name).cast("string"), F.lit(missing))
    return lifecycle.groupBy(label.alias("priority")).agg(
        F.count("task_id").alias("total_tasks"),
        F.count(F.when(F.col("is_completed"), F.lit(1))).alias("completed"),
        F.count(F.when(F.col("is_overdue"), F.lit(1))).alias("overdue"),
    )


METRIC_LABELS = {"total_tasks": "total tasks", "completed": "completed", "overdue": "overdue"}


def priority_long(stats: DataFrame, labels: Mapping[str, str] = METRIC_LABELS) -> DataFrame:
    """One row per priority and measure, with the measure's display label."""
    long = stats.unpivot(["priority"], ["total_tasks", "completed", "overdue"], "metric", "cnt")
    label = F.col("metric")
    for name, text in labels.items():
        label = F.when(F.col("metric") == name, F.lit(text)).otherwise(label)
    return long.withColumn("metric_label", label)


def _durations(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.filter(F.col("complete_duration_seconds") >= 0)


def duration_histogram(lifecycle: DataFrame, bins: int = 40) -> DataFrame:
    """Non-negative completion times in ``bins`` equal bins; empty bins have no row.

    Durations are counted per value first, and the range and the bins both come
    from those counts. The filter is always true: it makes both read the same
    columns, so that the counting runs once.
    """
    value = F.col("complete_duration_seconds")
    counted = (
        _durations(lifecycle)
        .groupBy("complete_duration_seconds")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 0")
    )
    low = counted.agg(F.min("complete_duration_seconds").alias("lo")).scalar()
    high = counted.agg(F.max("complete_duration_seconds").alias("hi")).scalar()
    width = (high - low).cast("double") / bins
    place = F.floor((value - low).cast("double") / F.nullif(width, F.lit(0.0)))
    index = F.least(F.coalesce(place, F.lit(0).cast("bigint")), F.lit(bins - 1).cast("bigint"))
    binned = counted.groupBy(index.alias("bin")).agg(F.sum("n").alias("cnt"))
    return binned.select(
        "bin",
        (low + F.col("bin") * width).alias("bin_start"),
        (low + (F.col("bin") + 1) * width).alias("bin_end"),
        "cnt",
    )


QUARTILES = {
    "min_seconds": 0.0, "q1_seconds": 0.25, "median_seconds": 0.5, "q3_seconds": 0.75,
    "max_seconds": 1.0,
}
HOUR_SECONDS = 3600


def duration_box_by_priority(lifecycle: DataFrame) -> DataFrame:
    """Five-number summary of non-negative completion times per priority."""
    return exact_quantiles(
        _durations(lifecycle), "priority", "complete_duration_seconds", QUARTILES, HOUR_SECONDS
    )


# Text that places an event type in a funnel step, in step order.
FUNNEL_STEPS = {
    "created": ("create",),
    "completed": ("complete",),
    "deleted": ("delete",),
    "postponed": ("postpon", "delay"),
}


def task_funnel(events: DataFrame) -> DataFrame:
    """Distinct tasks per step and their percentage of the first step.

    Events are reduced to one row of step flags per task before counting.
    """
    kind = F.lower(F.col("event_type").cast("string"))

    def step(words: tuple[str, ...]) -> Column:
        found = [kind.contains(w) for w in words]
        matched = found[0]
        for other in found[1:]:
            matched = matched | other
        return F.coalesce(matched, F.lit(False))

    per_task = (
        events.filter(F.col("task_id").isNotNull())
        .groupBy("task_id")
        .agg(*[F.max(step(words).cast("int")).alias(n) for n, words in FUNNEL_STEPS.items()])
    )
    totals = per_task.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in FUNNEL_STEPS]
    )
    rows = [
        F.struct(
            F.lit(i).alias("step_no"),
            F.lit(n).alias("step"),
            F.col(n).alias("task_cnt"),
            (ratio(F.col(n), F.col("created")) * 100).alias("pct_of_first"),
        )
        for i, n in enumerate(FUNNEL_STEPS, start=1)
    ]
    return totals.select(F.inline(F.array(*rows)))


def ordered_funnel(
    events: DataFrame,
    steps: Sequence[str] = ("create_task", "edit_task", "complete_task", "delete_task"),
    within_days: int = 365,
    time: str = "event_time",
    **join_options,
) -> DataFrame:
    """``step_no, step, furthest_cnt, reached_cnt, pct_of_first``: tasks by the furthest of
    ``steps`` that they reach in this order.

    A task enters with its earliest first step. Each later step counts at its earliest time
    that is not before the step it follows and at most ``within_days`` days after the
    entry; a task without it goes no further. The steps are folded from the left: every
    step reads its own events once, looks up how far their tasks have come, and stores
    one row per task, whose size decides how the next step joins it. A task may have any
    share of the events.
    """
    folder = scratch_path(events.sparkSession, "funnel")

    def of(kind: str) -> DataFrame:
        chosen = (F.col("event_type") == kind) & F.col("task_id").isNotNull() & F.col(time).isNotNull()
        return events.filter(chosen).select("task_id", F.col(time).alias("at"), "event_id")

    limit = F.expr(f"INTERVAL '{within_days}' DAY")
    entered = of(steps[0]).groupBy("task_id").agg(F.min("at").alias("entry")).withColumn("since", F.col("entry"))
    reached = [publish(entered, folder, "step_1")]
    for n, kind in enumerate(steps[1:], 2):
        came = lookup_join(of(kind), reached[-1], "task_id", spread="event_id", **join_options)
        fits = (F.col("at") >= F.col("since")) & (F.col("at") <= F.col("entry") + limit)
        came = came.filter(fits).groupBy("task_id").agg(F.min("entry").alias("entry"), F.min("at").alias("since"))
        reached.append(publish(came, folder, f"step_{n}"))
    counts = [
        df.agg(F.count(F.lit(1)).alias("reached_cnt")).select(
            F.lit(n).alias("step_no"), F.lit(kind).alias("step"), "reached_cnt"
        )
        for n, (kind, df) in enumerate(zip(steps, reached), 1)
    ]
    # One row for each step.
    by_step = Window.partitionBy(F.lit(1)).orderBy("step_no")
    following = F.lead("reached_cnt", 1, 0).over(by_step)
    first = F.first("reached_cnt").over(by_step)
    return reduce(DataFrame.unionByName, counts).select(
        "step_no", "step", (F.col("reached_cnt") - following).alias("furthest_cnt"), "reached_cnt",
        (ratio(F.col("reached_cnt"), first) * 100).alias("pct_of_first"),
    )


def duration_sketches(lifecycle: DataFrame, k: int = 200) -> DataFrame:
    """``priority, date, n, sketch``: completion times as quantile sketches of bounded size,
    a row for each priority and day of completion. Stored, they merge over any days."""
    return (
        _durations(lifecycle).filter(F.col("priority").isNotNull())
        .groupBy("priority", F.col("first_complete_time").cast("date").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.kll_sketch_agg_bigint(F.col("complete_duration_seconds"), k).alias("sketch"),
        )
    )


def sketched_box(sketches: DataFrame, k: int = 200) -> DataFrame:
    """``duration_box_by_priority`` of the days in ``sketches``, from them alone. Every
    quantile is a value whose rank is off by some 1.65 / ``k`` of the rows at most (99 % sure)."""
    merged = sketches.groupBy("priority").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint(F.col("sketch"), k).alias("sketch")
    )
    return merged.select(
        "priority", "n",
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias(name) for name, q in QUARTILES.items()],
    )


def rank_errors(box: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """``priority, quantile, n, rank_error``: how far, as a share of the rows, the ranks of
    each approximate value in ``box`` lie from the quantile it stands for (0: within them)."""
    wanted = F.create_map(*[x for name, q in QUARTILES.items() for x in (F.lit(name), F.lit(float(q)))])
    asked = box.unpivot(["priority", "n"], list(QUARTILES), "quantile", "value").withColumn(
        "wanted", wanted[F.col("quantile")]
    )
    # Values are counted per priority first; five limits per priority meet each count.
    counted = (
        _durations(lifecycle).filter(F.col("priority").isNotNull())
        .groupBy("priority", "complete_duration_seconds").agg(F.count(F.lit(1)).alias("c"))
    )
    limits = asked.groupBy("priority").agg(F.collect_list(F.struct("quantile", "value", "wanted", "n")).alias("asked"))
    limits = publish(limits, scratch_path(box.sparkSession, "limits"), "asked")
    met = lookup_join(counted, limits, "priority", spread="complete_duration_seconds").select(
        "complete_duration_seconds", "c", "priority", F.inline("asked")
    )
    x = F.col("complete_duration_seconds")
    ranks = met.groupBy("priority", "quantile", "n", "wanted").agg(
        F.sum(F.when(x < F.col("value"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(x <= F.col("value"), F.col("c")).otherwise(0)).alias("upto"),
    )
    low, high = ratio(F.col("below"), F.col("n")), ratio(F.col("upto"), F.col("n"))
    error = F.greatest(low - F.col("wanted"), F.col("wanted") - high, F.lit(0.0))
    return ranks.select("priority", "quantile", "n", error.alias("rank_error"))
