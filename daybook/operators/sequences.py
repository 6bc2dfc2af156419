"""Frequent sequences of event types within sessions, by prefix growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.times import time_slot
from daybook.session import scratch_path
from daybook.sources.files import publish

SEPARATOR = " > "


def session_chunks(rows: DataFrame, types: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``session, chunk, here, later``: the events of each chunk of a session in order,
    as ``(place, type)``, and for each of ``types`` its first place in a later chunk.

    ``rows`` has ``session, chunk, place, type`` and the columns ``by``, which are the same
    in all rows of a session. Only one row for each chunk is ordered per session. Sessions
    with a single row are left out, as nothing follows it.
    """
    firsts = [F.min(F.when(F.col("type") == t, F.col("place"))).alias(f"first_{i}") for i, t in enumerate(types)]
    chunks = rows.groupBy(*by, "session", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("place", "type"))).alias("here"), *firsts
    )
    in_order = Window.partitionBy(*by, "session").orderBy(F.desc("chunk"))
    backwards = in_order.rowsBetween(Window.unboundedPreceding, -1)
    later = F.array(*[F.min(f"first_{i}").over(backwards) for i in range(len(types))])
    chunks = chunks.withColumns(
        {"later": later, "next": F.lag("chunk").over(in_order), "last": F.lead("chunk").over(in_order)}
    )
    alone = (F.size("here") == 1) & F.col("next").isNull() & F.col("last").isNull()
    return chunks.filter(~alone).select("session", "chunk", "here", "later")


def _frequent(states: DataFrame, min_sessions: int) -> DataFrame:
    """Sequences of ``states``, which has one row for each session and sequence."""
    return states.groupBy("seq").agg(F.count(F.lit(1)).alias("session_cnt")).filter(
        F.col("session_cnt") >= min_sessions
    )


def _grown(states: DataFrame, chunks: DataFrame, types: Sequence[str], chunk_seconds: int) -> DataFrame:
    """States one event longer: for every type its first place after that of the state."""
    met = states.join(chunks, ["session", "chunk"])
    rest = F.filter("here", lambda e: e["place"] > F.col("place"))

    def step(i: int, kind: str) -> Column:
        soonest = F.try_element_at(F.filter("rest", lambda e: e["type"] == kind), F.lit(1))["place"]
        return F.struct(F.lit(kind).alias("type"), F.coalesce(soonest, F.col("later")[i]).alias("place"))

    steps = [step(i, kind) for i, kind in enumerate(types)]
    nexts = F.filter(F.array(*steps), lambda s: s["place"].isNotNull())
    grown = met.withColumn("rest", rest).select("session", "seq", F.inline(nexts).alias("type", "place"))
    return grown.select(
        "session", F.concat("seq", F.array("type")).alias("seq"), "place",
        time_slot(F.col("place.at"), chunk_seconds).alias("chunk"),
    )


def frequent_sequences(
    events: DataFrame,
    min_sessions: int,
    max_length: int = 4,
    session: str = "session_id",
    time: str = "event_time",
    tie: str = "event_id",
    chunk_seconds: int = 60,
    by: Sequence[str] = (),
) -> DataFrame:
    """``sequence, length, session_cnt``: the sequences of up to ``max_length`` event types
    that at least ``min_sessions`` sessions contain, in this order, with any events
    in between.

    A state is a session, a frequent sequence and the earliest place at which the session
    completes it. Each level looks up what follows the states and prunes what too few
    sessions have, so its work grows with the sessions that still take part, and longer
    sequences are only made of frequent ones. Levels are stored, each built from the
    one before.

    A session may hold any share of the log: it is cut into chunks of time, and a state is
    looked up in its chunk alone. Events without session, time or type take no part.
    ``by`` names columns that are the same in all events of a session, such as its user:
    events that are together by them are not shuffled again.
    """
    spark = events.sparkSession
    folder = scratch_path(spark, "sequences")
    rows = events.select(
        *by,
        F.col(session).alias("session"),
        time_slot(F.col(time), chunk_seconds).alias("chunk"),
        F.struct(F.col(time).alias("at"), F.col(tie).alias("tie")).alias("place"),
        F.col("event_type").alias("type"),
    ).filter("session IS NOT NULL AND chunk IS NOT NULL AND type IS NOT NULL")
    single = rows.select(*by, "session", "type").distinct().select(F.array("type").alias("seq"))
    found = publish(_frequent(single, min_sessions), folder, "frequent_1")
    # Event types are a vocabulary of the application, not of the data's size.
    types = sorted(r.seq[0] for r in found.select("seq").collect())
    result = found
    if types and max_length > 1:
        chunks = publish(session_chunks(rows.filter(F.col("type").isin(types)), types, by), folder, "chunks")
        first = chunks.select("session", F.inline("here")).groupBy("session", "type").agg(F.min("place").alias("place"))
        states = first.select(
            "session", F.array("type").alias("seq"), "place",
            time_slot(F.col("place.at"), chunk_seconds).alias("chunk"),
        )
    for length in range(2, max_length + 1 if types else 0):
        kept = states.join(found.select("seq"), "seq", "left_semi")
        states = publish(_grown(kept, chunks, types, chunk_seconds), folder, f"level_{length}")
        found = publish(_frequent(states, min_sessions), folder, f"frequent_{length}")
        if found.isEmpty():
            break
        result = result.unionByName(found)
    return result.select(
        F.concat_ws(SEPARATOR, "seq").alias("sequence"), F.size("seq").alias("length"), "session_cnt"
    )
