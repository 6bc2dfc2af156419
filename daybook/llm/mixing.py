"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words of its source up
to and including it, in shuffled order, divided by the source's weight. Sorting
all copies by finish time serves the sources in proportion to their weights; a
source with no copies left leaves its share to the others. The mix is cut where
its words reach the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import packed_rows, row_digest, running_total, shuffle_partitions, store, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
# Pieces for each shuffle partition into which running sums are cut.
PIECES = 4


def targets(sizes: DataFrame, weights: Sequence[float], copies: int, budget: float = 1.0) -> DataFrame:
    """``source, weight, source_size, target, finish``, one row for each source.

    ``sizes`` has ``source, source_size``. ``finish`` is the virtual time at which
    the mix ends, the same for all. Targets share ``budget`` times all sizes by
    weight, none above ``copies`` times its source, what is over being shared
    again. The windows without keys see one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    named = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)
    )
    named = named.withColumns({
        "room": F.col("source_size") * F.lit(float(copies)),
        "full_at": F.col("source_size") * F.lit(float(copies)) / F.col("weight"),
    })
    # By the time at which a source is used up: those before are full, the rest
    # still draw by weight.
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    level = (total - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = named.withColumn("level", level)
    # Levels rise up to the first that does not pass its own source's end, and fall
    # after it. Where all pass, every source is used up.
    fits = F.when(F.col("level") <= F.col("full_at"), F.col("level"))
    finish = F.coalesce(F.max(fits).over(everything), F.max("full_at").over(everything))
    done = levelled.withColumn("finish", finish)
    target = F.least(F.col("weight") * F.col("finish"), F.col("room"))
    return done.select("source", "weight", "source_size", target.alias("target"), "finish")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    budget: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """Copies taken, in the order of the mix: ``doc_id, source, size, source_size,
    target, finish_time, epoch, digest``, a row for each copy.

    * Sources come by code point, NULL last, and take the weights in turn.
    * Documents are shuffled by a seeded hash of their columns; a source that needs
      more than it has goes round again, ``max_copies`` times at most.
    * Copies are taken up to the source's target, the one that crosses it if that comes
      nearer to the target than leaving it, and likewise up to the budget of all. A
      source misses its target by half a document at most, and by those that the
      budget cuts off the end of the whole mix.
    * NULL text has size 0. Documents of size 0 take no words and are not in the mix.
    * Rows that repeat an id and text are separate documents. An empty table gives
      an empty result.
    """
    return _take(*_sizes(docs, weights, max_copies, budget), max_copies, budget, seed)


def allot(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    budget: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, copy, digest`` for every row
    of ``docs``: the words that ``mix`` takes from it, repeats counted."""
    light, plan = _sizes(docs, weights, max_copies, budget)
    taken = _take(light, plan, max_copies, budget, seed).groupBy("doc_id", "digest", "source", "copy")
    taken = taken.agg(F.sum("size").alias("taken")).select(
        F.col("doc_id").alias("_doc_id"), F.col("digest").alias("_digest"),
        F.col("source").alias("_source"), F.col("copy").alias("_copy"), "taken",
    )
    each = _with_plan(light, plan).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    found = each.join(
        taken,
        each["doc_id"].eqNullSafe(taken["_doc_id"]) & (each["digest"] == taken["_digest"])
        & each["source"].eqNullSafe(taken["_source"]) & (each["copy"] == taken["_copy"]),
        "left",
    )
    return found.select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source", "copy", "digest",
    )


def _sizes(docs: DataFrame, weights, max_copies: int, budget: float) -> tuple[DataFrame, DataFrame]:
    """Documents without texts, equal rows counted; and the sources' targets."""
    sized = docs.select(
        "doc_id", "source", word_count(docs["text"]).alias("size"), row_digest(docs).alias("digest")
    )
    light = store(
        sized.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("rows")), "sizes"
    )
    sizes = light.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    return light, store(targets(sizes, weights, max_copies, budget), "targets")


def _with_plan(light: DataFrame, plan: DataFrame) -> DataFrame:
    named = plan.select(F.col("source").alias("_source"), "weight", "source_size", "target", "finish")
    return light.join(named, light["source"].eqNullSafe(named["_source"])).drop("_source")


def _take(
    light: DataFrame, plan: DataFrame, max_copies: int, budget: float, seed: int
) -> DataFrame:
    spark = light.sparkSession
    each = _with_plan(light.filter("size > 0"), plan)
    rounds = F.least(F.ceil(F.col("target") / F.col("source_size")), F.lit(max_copies)).cast("int")
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    copies = each.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(rounds, F.lit(1)) - 1)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "digest", "doc_id", "copy"), 2)
    pieces = shuffle_partitions(spark) * PIECES
    copies = copies.withColumn("draw", draw).withColumn(
        "piece", F.floor(F.col("draw") / F.lit(float(1 << 62)) * pieces).cast("int")
    )
    queued = running_total(
        copies, ["source", "epoch"], "piece",
        [F.col("draw"), F.col("doc_id"), F.col("copy")], words="size",
    )
    served = queued.withColumn("served", F.col("words") + F.col("epoch") * F.col("source_size"))
    served = served.withColumn("finish_time", F.col("served") / F.col("weight"))
    # The document that crosses the target is taken if that brings the source nearer to it.
    served = served.filter(F.col("served") * 2 - F.col("size") <= F.col("target") * 2)
    # Cut at the budget: running sums in the order of finish times, cut by time.
    served = store(
        served.withColumn(
            "slice",
            F.when(F.col("finish") > 0, F.floor(F.col("finish_time") / F.col("finish") * pieces))
            .otherwise(0).cast("int"),
        ),
        "served",
    )
    order = ["finish_time", "source", "draw", "doc_id", "epoch", "copy"]
    total = plan.agg((F.sum("source_size") * F.lit(float(budget))).alias("budget"))
    summed = running_total(served.withColumn("all", F.lit(0)), ["all"], "slice", [F.col(c) for c in order], mixed="size")
    kept = summed.filter(F.col("mixed") * 2 - F.col("size") <= total.scalar() * 2)
    return kept.select(
        "doc_id", "source", "size", "source_size", "target", "finish_time", "epoch", "copy", "digest"
    ).orderBy("finish_time", F.col("source").asc_nulls_last(), "digest", "doc_id", "epoch", "copy")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in its order."""
    taken = mix(docs).select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_key"), F.col("source").alias("_from"),
        F.col("copy").alias("_nth"), "finish_time", "epoch",
    )
    rows = packed_rows(docs, "source")
    found = rows.join(
        taken,
        rows["doc_id"].eqNullSafe(taken["_id"]) & (rows["digest"] == taken["_key"])
        & rows["source"].eqNullSafe(taken["_from"]) & (rows["copy"] == taken["_nth"]),
    )
    return found.orderBy("finish_time", "digest", "epoch").select("row.*")
