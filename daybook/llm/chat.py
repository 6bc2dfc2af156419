"""Chat formatting of logged conversations, cumulative snapshots collapsed.

A chat log often holds a conversation many times, each time a few turns longer.
Every turn gets a rolling hash of all turns up to it. A conversation whose last
hash is found inside another one is a snapshot of it and goes; of equal
conversations the smallest id stays. What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import running_total, store

MAX_CHARS = 8000


def _hash(seed: int, *columns: Column | str) -> Column:
    """A hash that can be summed without overflow."""
    return F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: each different turn once."""
    known = [F.coalesce(conversations[c], F.lit("")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", "turn", *known).distinct()


def number_turns(rows: DataFrame, step: int = 1000) -> DataFrame:
    """Add ``pos``, the place of a turn in its conversation from 1 up, by turn (NULL
    first), role and text. Long conversations are numbered in pieces of ``step``
    turn numbers."""
    piece = F.coalesce(F.floor(F.col("turn") / step), F.lit(-(1 << 62))).cast("bigint")
    ordered = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return running_total(rows.withColumn("piece", piece), ["conv_id"], "piece", ordered, pos="1").drop("piece")


def prefix_hashes(numbered: DataFrame, step: int = 1000) -> DataFrame:
    """``conv_id, pos, p1, p2``: hashes of the turns up to each one. A sum of hashes
    of (place, role, text) rolls on by one addition and needs no order of adding."""
    light = numbered.select(
        "conv_id", "pos", F.floor(F.col("pos") / step).alias("piece"),
        _hash(1, "pos", "role", "text").alias("t1"), _hash(2, "pos", "role", "text").alias("t2"),
    )
    summed = running_total(light, ["conv_id"], "piece", [F.col("pos")], p1="t1", p2="t2")
    return summed.select("conv_id", "pos", "p1", "p2")


def maximal(hashes: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of conversations that no other one begins with, of equal
    ones the smallest id."""
    ends = hashes.groupBy("conv_id").agg(
        F.max(F.struct("pos", "p1", "p2")).alias("end")
    ).select("conv_id", F.col("end.pos").alias("n_turns"), "end.p1", "end.p2")
    ids = ends.select(F.col("conv_id").alias("_conv_id"), "n_turns")
    inside = hashes.join(ids, hashes["conv_id"].eqNullSafe(ids["_conv_id"])).filter("pos < n_turns")
    inner = inside.select(F.col("pos").alias("n_turns"), "p1", "p2").distinct()
    whole = ends.groupBy("n_turns", "p1", "p2").agg(F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("first"))
    return whole.join(inner, ["n_turns", "p1", "p2"], "left_anti").select(
        F.col("first.conv_id").alias("conv_id"), "n_turns"
    )


def format_chats(conversations: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``conv_id, part, n_turns, first_turn, text``: the maximal conversations as text.

    Each turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. A conversation is
    cut between turns into parts: a part takes the turns that begin within the same
    ``max_chars`` characters of the rendered conversation, so a part is at most that
    long plus one turn, and the parts in order are the whole conversation.
    ``n_turns`` and ``first_turn`` (its place, from 1) describe the part.

    * Turns go by turn number, NULL first, then role, then text; gaps in the numbers
      do not matter. NULL roles and texts are empty ones.
    * Repeated rows are one turn. Rows with a NULL ``conv_id`` are one conversation.
    * Conversations are compared by 128 bits of hash of all their roles and texts.
    * An empty table gives an empty result; other columns are not looked at.
    """
    # The numbered turns are read by both passes below.
    numbered = store(number_turns(turns(conversations)), "turns")
    kept = maximal(store(prefix_hashes(numbered), "hashes")).select(F.col("conv_id").alias("_conv_id"))
    stay = numbered.join(kept, numbered["conv_id"].eqNullSafe(kept["_conv_id"]), "left_semi")
    body = F.concat(
        F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")
    )
    rendered = stay.select("conv_id", "pos", body.alias("body"))
    light = rendered.select(
        "conv_id", "pos", F.char_length("body").cast("bigint").alias("chars"),
        F.floor(F.col("pos") / 1000).alias("piece"),
    )
    ends = running_total(light, ["conv_id"], "piece", [F.col("pos")], upto="chars")
    cut = ends.select(
        F.col("conv_id").alias("_conv_id"), F.col("pos").alias("_pos"),
        F.floor((F.col("upto") - F.col("chars")) / max_chars).cast("bigint").alias("part"),
    )
    placed = rendered.join(
        cut, rendered["conv_id"].eqNullSafe(cut["_conv_id"]) & (rendered["pos"] == cut["_pos"])
    )
    # A part is bounded, so its turns may meet; their texts are joined in order.
    parts = placed.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("turns")
    )
    return parts.select(
        "conv_id", "part",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.get("turns", F.lit(0))["pos"].cast("bigint").alias("first_turn"),
        F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("text"),
    )
