"""Target-distribution resampling by hashed n-grams of byte-translated words.

A table of 256 bytes lower-cases a text and blanks its separators, ``bytes.split``
gives the words, and the ``crc32`` of a run of words is extended to the next word by
passing it as the seed, so that no n-gram is ever put together. Counters of the
buckets are summed over the tasks for all documents and for the target texts; a
bucket's gain is the scaled log ratio of the two. The documents with the largest
sum of gains plus a Gumbel number drawn from their id are the sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import running_total, store, word_lists

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
# Scores whose numbers of documents one task adds up.
SCORE_RANGE = 1 << 16


def bucket_lists(raw: bytes, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of new words, and buckets of the runs of 1 to ``longest`` words that end in
    one of them, for each piece of a text."""
    before: list[bytes] = []
    for new in word_lists(raw):
        words = before + new
        runs = list(map(crc32, words))
        hashes = runs[len(before) :]
        for n in range(1, longest):
            # runs[i] covers the words i to i + n - 1; a blank and the next word follow.
            runs = list(map(crc32, words[n:], map(crc32, repeat(b" "), runs)))
            hashes += runs[max(len(before) - n, 0) :]
        yield len(new), np.array(hashes, np.int64) % buckets
        before = words[max(len(words) - longest + 1, 0) :] if longest > 1 else []


def _raw(scalar) -> bytes:
    return scalar.as_py() or b""


def bucket_counts(texts: DataFrame, name: str, longest: int, buckets: int) -> DataFrame:
    """``bucket``, ``name``: n-grams of all texts in every bucket that has any. A task
    sends its Counter of at most ``buckets`` numbers."""

    def work(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for _, found in bucket_lists(_raw(text), longest, buckets):
                    counts.update(found.tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["bucket", "n"]
        )

    parts = texts.select(F.col("text").cast("binary")).mapInArrow(work, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: ``floor(1000 * ln((t+1)(S+buckets) / ((s+1)(T+buckets))))``.

    Only the ``buckets`` numbers come to the driver, however large the tables are.
    """
    counted = (
        docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
        .join(bucket_counts(docs, "s", longest, buckets), "bucket", "left")
        .join(bucket_counts(target, "t", longest, buckets), "bucket", "left")
        .fillna(0, ["s", "t"])
        # One row for each bucket.
        .withColumns({name: F.sum(name[-1]).over(Window.partitionBy()) for name in ("all_s", "all_t")})
    )
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / (
        (F.col("s") + 1.0) * (F.col("all_t") + float(buckets))
    )
    rows = counted.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    gains = np.zeros(buckets, np.int64)
    gains[[r.bucket for r in rows]] = [r.gain for r in rows]
    return gains


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    buckets = len(gains)

    def work(batches):
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(1)):
                for words, found in bucket_lists(_raw(text), longest, buckets):
                    rows[i] += (words, len(found), gains[found].sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(rows[:, i]) for i in range(3))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    ddl = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(work, ddl)


def gumbel(doc_id: Column, seed: int) -> Column:
    """``floor(1000 * Gumbel)`` from the first 32 bits of ``sha256('seed:id')``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    share = (drawn + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def draw(scored: DataFrame, k: int) -> DataFrame:
    """``scored`` (``doc_id, eligible, score``, ...) with the ``rank`` of its ``k`` highest
    scores among the eligible rows, ties to the smaller id, NULL for all others.

    Rows are counted by score, the counts summed down the scores; only rows of one score
    are ordered among themselves. No task sees all rows: the widest window holds one
    row for ``SCORE_RANGE`` scores.
    """
    counts = scored.filter("eligible").groupBy((-F.col("score")).alias("down")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("range", F.floor(F.col("down") / SCORE_RANGE))
    above = running_total(counts, [], "range", [F.col("down")], upto="n").select(
        (-F.col("down")).alias("_score"), (F.col("upto") - F.col("n")).alias("_above")
    )
    reached = above.filter(F.col("_above") < k)
    joined = scored.join(reached, F.col("eligible") & (F.col("score") == F.col("_score")), "left")
    tied = Window.partitionBy("score", "eligible").orderBy("doc_id", "n_features", "weight")
    rank = F.col("_above") + F.row_number().over(tied)
    return joined.withColumn("rank", F.when(rank <= k, rank)).drop("_score", "_above")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs``.

    * Of the rows with ``min_words`` words, ``percent`` in 100 (rounded down) have a rank.
    * NULL and empty texts have no words and weight 0. A NULL id is hashed as empty and
      is the smallest. Rows that repeat an id are rows of their own, ties among them
      by number of features and weight.
    * Without target texts, or without documents, the counts are 0 and the formula holds.
    * Only ``doc_id`` and ``text`` are read, whatever other columns are called.
    """
    gains = bucket_gains(docs, target, longest, buckets)
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    scored = weigh(docs, gains, longest).withColumns({"score": score, "eligible": F.col("n_words") >= min_words})
    scored = store(scored, "weighed")
    k = percent * scored.filter("eligible").count() // 100
    return draw(scored, k).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
