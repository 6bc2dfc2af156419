"""Derivations: sessions, calendar, events from tasks, attributes, scores, ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.lookups import ROWS_PER_SPLIT, fits_broadcast, heavy_keys, lookup_join
from daybook.functions.times import time_slot
from daybook.functions.values import date_from_text
from daybook.session import scratch_path
from daybook.sources.files import publish


def user_slots(events: DataFrame, user: str, time: str, max_gap_minutes: int) -> DataFrame:
    """First and last time and rows of every (user, slot), a slot as wide as the gap."""
    slot = time_slot(F.col(time), max_gap_minutes * 60)
    return (
        events.select(user, time, slot.alias("slot"))
        .filter(F.col(user).isNotNull() & F.col("slot").isNotNull())
        .groupBy(user, "slot")
        .agg(
            F.min(time).alias("first_time"),
            F.max(time).alias("last_time"),
            F.count(F.lit(1)).alias("n"),
        )
        # Always true. With the filter above it makes every use of the slots read the
        # same rows and columns, so that Spark sees one shuffle and runs it once.
        .filter("n > 0 AND first_time <= last_time")
    )


def session_numbers(slots: DataFrame, user: str, max_gap_minutes: int) -> DataFrame:
    """Ordinal session of every (user, slot).

    Two events in one slot are never more than the gap apart, so a slot belongs
    to one session, and a session can only start at the first event of a slot.
    Only the first and last time per slot are needed: the rows of a hot user
    combine before the shuffle, and the window sees slots instead of events.
    """
    in_order = Window.partitionBy(user).orderBy("slot")
    gap = F.expr(f"INTERVAL '{max_gap_minutes}' MINUTE")
    # With a slot in between the pause is over the limit; only neighbours are measured.
    apart = F.col("last_slot").isNull() | (F.col("slot") > F.col("last_slot") + 1)
    starts = (
        F.when(apart, 1).when(F.col("first_time") - F.col("before") > gap, 1).otherwise(0)
    )
    return (
        slots.withColumns(
            {"last_slot": F.lag("slot").over(in_order), "before": F.lag("last_time").over(in_order)}
        )
        .withColumn("starts", starts.cast("bigint"))
        .select(user, "slot", F.sum("starts").over(in_order).alias("session_idx"))
    )


def session_id(user: Column, session_idx: Column) -> Column:
    """``<user>_sess_<number>``, the number padded to at least four digits."""
    return F.concat(user.cast("string"), F.lit("_sess_"), padded(session_idx, 4))


def padded(number: Column, digits: int) -> Column:
    """Number as text with leading zeros; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.when(number < 10 ** (digits - 1), F.lpad(text, digits, "0")).otherwise(text)


# Rows of one user that are put in order at once.
ROWS_PER_USER = 250_000


def heavy_users(events: DataFrame, user: str, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Users, NULL among them, with too many events to be put in order by one task."""
    return heavy_keys(events, [user], min(rows_per_split, ROWS_PER_USER), nulls=True)[user]


def _sessions_in_order(
    events: DataFrame, user: str, time: str, max_gap_minutes: int, columns: list[str], min_rows: int
) -> DataFrame:
    """``columns``, ``session_idx``: events of each user numbered in order of time.

    One shuffle by user, which what follows by user finds in place.
    """
    in_order = Window.partitionBy(user).orderBy(time)
    apart = F.col(time) - F.col("before_") > F.expr(f"INTERVAL '{max_gap_minutes}' MINUTE")
    starts = F.when(F.col(time).isNull(), 0).when(F.col("before_").isNull() | apart, 1).otherwise(0)
    number = F.sum(starts.cast("bigint")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = events.withColumn("before_", F.lag(time).over(in_order)).select(
        *columns, F.when(F.col(user).isNotNull() & F.col(time).isNotNull(), number).alias("session_idx")
    )
    if min_rows > 1:
        size = F.count(F.lit(1)).over(Window.partitionBy(user, "session_idx"))
        lost = F.col("session_idx").isNull()
        numbered = numbered.withColumn("rows_", size).filter(lost | (F.col("rows_") >= min_rows))
    return numbered.select(*columns, "session_idx")


def _sessions_by_slot(
    events: DataFrame, slots: DataFrame, user: str, time: str, max_gap_minutes: int, columns: list[str],
    min_rows: int, spread: str | Sequence[str], **join_options,
) -> DataFrame:
    """``columns``, ``session_idx``: the numbers of slots looked up for their events."""
    rows = events.withColumn("slot", time_slot(F.col(time), max_gap_minutes * 60))
    numbers = session_numbers(slots, user, max_gap_minutes)
    if min_rows > 1:
        of_session = Window.partitionBy(user, "session_idx")
        sized = numbers.join(slots.select(user, "slot", "n"), [user, "slot"]).withColumn(
            "rows", F.sum("n").over(of_session)
        )
        numbers = sized.filter(F.col("rows") >= min_rows).select(user, "slot", "session_idx")
    joined = lookup_join(
        rows, numbers, [user, "slot"], spread, counts=slots.select(user, "slot", "n"), **join_options
    )
    if min_rows > 1:
        without = F.col(user).isNull() | F.col("slot").isNull()
        joined = joined.filter(F.col("session_idx").isNotNull() | without)
    return joined.select(*columns, "session_idx")


def assign_sessions(
    events: DataFrame,
    user: str = "user_id",
    time: str = "event_time",
    max_gap_minutes: int = 30,
    spread: str | Sequence[str] | None = None,
    min_rows: int = 1,
    heavy: DataFrame | None = None,
    **join_options,
) -> DataFrame:
    """Add ``session_id``: a new session after a gap strictly over the limit.

    Where the slots of the events fit a broadcast, their numbers are looked up. Otherwise
    events are put in order by user in one shuffle, all but those of users with more than
    ``ROWS_PER_USER`` rows, which are numbered by slots: ``heavy`` may list these
    (``heavy_users``), otherwise they are counted while the plan is made.

    ``spread`` names columns that vary among the events of one user (default:
    the event time), used where a slot is too large for one task. With ``min_rows``
    only events of sessions with at least so many rows are kept. Events
    without user or time have no session and count as one.
    """
    columns = [c for c in events.columns if c != "session_id"]
    identity = session_id(F.col(user), F.col("session_idx")).alias("session_id")
    settings = (user, time, max_gap_minutes, columns, min_rows)
    spread = spread or time
    slots = user_slots(events, user, time, max_gap_minutes)
    if fits_broadcast(slots, join_options.get("broadcast_bytes")):
        numbered = _sessions_by_slot(events, slots, *settings, spread, **join_options)
    else:
        if heavy is None:
            heavy = heavy_users(events, user, join_options.get("rows_per_split", ROWS_PER_SPLIT))
        listed = F.broadcast(heavy.select(F.col(user).alias("heavy_")))
        if heavy.isEmpty():
            numbered = _sessions_in_order(events, *settings)
        else:
            same = F.col(user).eqNullSafe(F.col("heavy_"))
            hot = events.join(listed, same, "left_semi")
            # Read for the numbers and for the heavy slots: one pass over the events.
            slots = publish(
                user_slots(hot, user, time, max_gap_minutes), scratch_path(events.sparkSession, "sessions"), "slots"
            )
            numbered = _sessions_by_slot(hot, slots, *settings, spread, **join_options).unionByName(
                _sessions_in_order(events.join(listed, same, "left_anti"), *settings)
            )
    if min_rows > 1:
        lost = events.filter(F.col(user).isNull() | F.col(time).isNull()).agg(F.count(F.lit(1)).alias("n"))
        numbered = numbered.filter(F.col("session_idx").isNotNull() | (lost.scalar() >= min_rows))
    return numbered.select(*columns, identity)


def event_date(time: Column) -> Column:
    """Partition key of an event: its day as ISO text."""
    return F.date_format(time, "yyyy-MM-dd")


def date_dim(bounds: DataFrame, holidays: Sequence[str] = ()) -> DataFrame:
    """Calendar with one row per day of ``bounds``' single (start, end) row."""
    day = F.col("day_")
    weekday = F.weekday(day) + 1
    return (
        bounds.select(F.explode(F.sequence(F.col("start"), F.col("end"))).alias("day_"))
        .select(
            F.date_format(day, "yyyyMMdd").alias("date_key"),
            F.date_format(day, "yyyy-MM-dd").alias("date_str"),
            F.year(day).alias("year"),
            F.month(day).alias("month"),
            F.dayofmonth(day).alias("day"),
            F.weekofyear(day).alias("week_of_year"),
            weekday.alias("day_of_week"),
            (weekday >= 6).cast("int").alias("is_weekend"),
            F.date_format(day, "yyyy-MM-dd").isin(*holidays).cast("int").alias("is_holiday"),
        )
    )


def day_bounds(df: DataFrame, time: str) -> DataFrame:
    """First and last day of a table, as the input of ``date_dim``."""
    return df.agg(
        F.min(F.to_date(time)).alias("start"), F.max(F.to_date(time)).alias("end")
    )


def milestone_events(task: DataFrame, delete_time: str = "delete_time") -> DataFrame:
    """One event per creation, completion and deletion of a task, in one scan."""
    def milestone(event_type: str, time: Column) -> Column:
        return F.struct(F.lit(event_type).alias("event_type"), time.alias("event_time"))

    deleted = F.col("task_status") == "deleted"
    milestones = F.array(
        milestone("create_task", F.col("create_time")),
        milestone("complete_task", F.when(F.col("is_completed"), F.col("complete_time"))),
        milestone("delete_task", F.when(deleted, F.col(delete_time))),
    )
    kept = F.filter(milestones, lambda m: m["event_time"].isNotNull())
    return task.select("*", F.inline(kept)).select(
        "user_id", "task_id", "list_id", "event_type", "event_time",
        "priority", "due_date", "has_reminder", "has_subtask",
    )


# Attribute keys of each event type, in stored order.
ATTRIBUTE_KEYS = {
    "create_task": ("priority", "due_date", "has_reminder", "has_subtask", "action_duration"),
    "complete_task": ("priority", "due_date", "action_duration"),
    "delete_task": ("priority", "due_date", "action_duration"),
    "edit_task": ("action_duration", "priority", "due_date", "has_reminder", "has_subtask"),
    "set_priority": (
        "action_duration", "priority", "due_date", "has_reminder", "has_subtask", "new_priority",
    ),
    "set_due_date": (
        "action_duration", "priority", "due_date", "has_reminder", "has_subtask", "new_due_date",
    ),
    "search_task": ("action_duration", "query", "result_count"),
    "use_feature": ("action_duration", "feature_name"),
    "app_close": ("action_duration", "close_reason"),
}
OTHER_KEYS = ("action_duration",)


def pack_attributes(
    events: DataFrame, keys: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Add ``attributes``: JSON text of the columns its event type carries.

    A key whose value is NULL is kept as JSON null; a column the frame lacks
    counts as NULL.
    """
    def packed(names: Sequence[str]) -> Column:
        fields = [
            (F.col(n) if n in events.columns else F.lit(None).cast("string")).alias(n)
            for n in names
        ]
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    text = None
    for event_type, names in (ATTRIBUTE_KEYS if keys is None else keys).items():
        matches = F.col("event_type") == event_type
        text = F.when(matches, packed(names)) if text is None else text.when(matches, packed(names))
    return events.withColumn("attributes", text.otherwise(packed(OTHER_KEYS)))


def postponed_tasks(events: DataFrame) -> DataFrame:
    """Tasks moved to a later due date, with the latest one and the moves made."""
    moved_to = date_from_text(F.col("attr_new_due_date"))
    return (
        events.filter(F.col("task_id").isNotNull())
        .withColumn("moved_to", moved_to)
        .filter(F.col("moved_to") > F.col("due_date").cast("date"))
        .groupBy("task_id", "due_date")
        .agg(
            F.max("moved_to").alias("latest_due_date"),
            F.count(F.lit(1)).alias("postpone_cnt"),
        )
    )


def event_transitions(
    events: DataFrame,
    session: str = "session_id",
    time: str = "event_time",
    tie: str = "event_id",
    chunk_seconds: int = 60,
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts of consecutive event types (from, to) within a session.

    ``by`` names columns that are the same in all events of a session, such as its user:
    events that are together by them are not shuffled again.

    A session may hold any share of the log, so it is cut into chunks of time. The events
    of a chunk are put in order once and stored as a list of types. Pairs inside a chunk
    are neighbours in its list; the pair across two chunks joins the last type of one to
    the first of the next, and only these are ordered per session.
    """
    rows = events.filter(F.col(session).isNotNull()).select(
        *by,
        F.col(session).alias("session"),
        time_slot(F.col(time), chunk_seconds).alias("chunk"),
        F.struct(F.col(time).alias("at"), F.col(tie).alias("tie"), F.col("event_type").alias("type")).alias("event"),
    )
    types = F.transform(F.sort_array(F.collect_list("event")), lambda e: e["type"])
    chunks = rows.groupBy(*by, "session", "chunk").agg(types.alias("types"))
    chunks = publish(
        chunks.select(
            "session", "chunk", F.try_element_at("types", F.lit(1)).alias("first"),
            F.try_element_at("types", F.lit(-1)).alias("last"), "types",
        ),
        scratch_path(events.sparkSession, "transitions"), "chunks",
    )
    after = F.slice("types", F.lit(2), F.size("types"))
    pairs = F.zip_with("types", after, lambda a, b: F.struct(a.alias("from_event"), b.alias("to_event")))
    inner = chunks.select(F.inline(pairs))
    across = Window.partitionBy("session").orderBy("chunk")
    outer = chunks.select(
        F.col("last").alias("from_event"), F.lead("first").over(across).alias("to_event")
    )
    return (
        inner.unionByName(outer)
        .filter("to_event IS NOT NULL")
        .groupBy("from_event", "to_event")
        .agg(F.count(F.lit(1)).alias("transition_cnt"))
    )
