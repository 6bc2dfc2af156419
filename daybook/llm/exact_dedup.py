"""Exact dedup: one row stays of every group of equal texts.

Copies are merged three times, and every merge groups by the whole text, never
by its digest alone:

1. locally, in the partial aggregation of each task, before anything is sent;
2. by (digest, salt, text): a group of copies is dealt over ``salts`` tasks;
3. by (digest, text): at most ``salts`` winners of a group meet.

The decision goes back to the documents by digest. Where one digest stands for
several texts, which a strong digest never shows, the texts decide there too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import ascii_lower, pick_rows, row_digest, store

SALTS = 32


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def combine(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row for each different text: ``digest, body, keep_id, group_size, variants``.

    ``variants`` counts the texts of the digest; ``body`` is NULL where it is 1.
    """
    body = ascii_lower(F.coalesce(docs["text"], F.lit("")))
    rows = docs.select("doc_id", body.alias("body")).withColumn("digest", digest(F.col("body")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    winners = salted.groupBy("salt", "digest", "body").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # One exchange by digest serves the last merge and the count of variants.
    meeting = winners.select("digest", "body", "keep_id", "group_size").repartition("digest")
    classes = meeting.groupBy("digest", "body").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    variants = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    classes = classes.withColumn("variants", variants)
    return classes.withColumn("body", F.when(F.col("variants") > 1, F.col("body")))


def exact_dedup(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, digest`` for every row of ``docs``;
    ``digest`` tells the row that is kept from others of its id.

    * Texts are equal when they are identical after lower-casing A-Z; NULL counts
      as the empty text, so NULL and empty texts are one group.
    * Of equal texts the row with the largest ``doc_id`` stays; a NULL id is the
      smallest. Rows that repeat the id as well are one row each, ``kept`` in one.
    * An empty table gives an empty result; other columns are not looked at.
    """
    classes = store(combine(docs, digest, salts), "classes")
    body = ascii_lower(F.coalesce(docs["text"], F.lit("")))
    rows = docs.select("doc_id", body.alias("body"), row_digest(docs).alias("row"))
    light = rows.withColumn("digest", digest(F.col("body"))).withColumn("text_sha256", sha256(F.col("body")))
    # Rows that repeat an id and a text are counted. Of those with the largest id, the
    # first by digest of the text as it is stays.
    own = ["digest", "doc_id", "text_sha256"]
    plain = classes.filter("variants = 1").select("digest", "keep_id", "group_size")
    copies = light.groupBy(*own).agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"))
    decided = copies.join(plain, "digest")
    clashes = classes.filter("variants > 1")
    if not clashes.isEmpty():
        bodies = clashes.select("digest", "body", "keep_id", "group_size")
        copies = light.groupBy(*own, "body").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"))
        decided = decided.unionByName(copies.join(bodies, ["digest", "body"]).drop("body"))
    each = decided.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", F.col("row").alias("digest")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return pick_rows(docs, exact_dedup(docs).filter("kept"))
