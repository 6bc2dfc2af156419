"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` keeps what has been seen of every line key: the number of documents
that hold it and the largest of their ids. Each batch is written as one more
sorted run; when a level has ``fanout`` runs, they are merged into one run of the
next level. A level is a table bucketed by hash, so a batch is shuffled once and
merge-joined to each level, while the runs stay where they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import SPACE_CHARS, ascii_lower, row_digest, scratch_path, shuffle_partitions, store

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 3
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def text_lines(docs: DataFrame) -> Column:
    """Lines of the text; NULL and empty texts are one empty line."""
    return F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)


def _is_long(line: Column, min_chars: int) -> Column:
    return F.char_length(F.btrim(line, F.lit(SPACE_CHARS))) >= min_chars


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, row, pos, h1, h2`` of every line whose key has ``min_chars`` code
    points; ``row`` tells rows of one id apart by their text."""
    lines = docs.select(
        "doc_id", row_digest(docs).alias("row"), F.posexplode(text_lines(docs)).alias("pos", "line")
    )
    long = lines.filter(_is_long(F.col("line"), min_chars))
    key = long.withColumn("key", line_key(F.col("line")))
    return key.select(
        "doc_id", "row", "pos",
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
    )


class LineRuns:
    """Levels of sorted runs of ``h1, h2, docs, last``.

    ``docs`` counts the documents that hold a line, ``last`` is their largest id.
    The batches must not share documents. Tables lie under the shared folder;
    ``drop`` removes them.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.path = scratch_path(spark, "runs")
        self.buckets = shuffle_partitions(spark)
        self.levels: list[tuple[str, int]] = []  # table and number of runs
        self.tables = 0

    def add(self, batch: DataFrame) -> None:
        """Add a batch of lines (``doc_id, h1, h2``) as a run of the first level."""
        held = batch.select(*HASH, "doc_id").distinct()
        run = held.groupBy(*HASH).agg(
            F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last")
        )
        self._append(0, run)
        level = 0
        while level < len(self.levels) and self.levels[level][1] >= self.fanout:
            self._compact(level)
            level += 1

    def _append(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append(("", 0))
        table, runs = self.levels[level]
        if not runs:
            table = f"{self.name}_{self.tables}"
            self.tables += 1
        # Dealt as the buckets are: a task writes one file of one bucket.
        dealt = run.repartition(self.buckets, *HASH)
        (
            dealt.write.mode("append").format("parquet")
            .bucketBy(self.buckets, *HASH).sortBy(*HASH)
            .option("path", f"{self.path}/{table}")
            .saveAsTable(table)
        )
        self.levels[level] = (table, runs + 1)

    def _compact(self, level: int) -> None:
        """Merge the runs of a level into one run of the next."""
        table, _ = self.levels[level]
        self._append(level + 1, self._merged(level))
        self.spark.sql(f"DROP TABLE {table}")
        self.levels[level] = ("", 0)

    def _merged(self, level: int) -> DataFrame:
        # Bucketed by hash: the runs of a level merge without a shuffle.
        return self.spark.table(self.levels[level][0]).groupBy(*HASH).agg(
            F.sum("docs").alias("docs"), F.max("last").alias("last")
        )

    def seen(self) -> DataFrame:
        """``h1, h2, docs, last`` over all levels, one row for each line."""
        parts = [self._merged(i) for i, (_, runs) in enumerate(self.levels) if runs]
        if not parts:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint, docs bigint, last bigint")
        if len(parts) == 1:
            return parts[0]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The batch's lines that no run holds: one merge-anti-join for each level."""
        for i, (table, runs) in enumerate(self.levels):
            if runs:
                batch = batch.join(self.spark.table(table).select(*HASH), list(HASH), "left_anti")
        return batch

    def unrepeated(self, batch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """The batch's lines without those that ``min_docs`` documents hold, save in
        the document with the largest id: a merge-anti-join with the runs."""
        often = self.seen().filter(F.col("docs") >= min_docs).select(
            F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "last"
        )
        elsewhere = ~batch["doc_id"].eqNullSafe(often["last"])
        same = (batch["h1"] == often["_h1"]) & (batch["h2"] == often["_h2"])
        # One key more than the buckets have: both sides are shuffled, the runs' few
        # lines again, so that adaptive execution can split a line that a third hold.
        same &= F.xxhash64(batch["h1"], batch["h2"]) == F.xxhash64(often["_h1"], often["_h2"])
        return batch.join(often, same & elsewhere, "left_anti")

    def drop(self) -> None:
        for table, runs in self.levels:
            if runs:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` for every row of ``docs``.

    * A text is split at ``\\n``; NULL and empty texts are one empty line.
    * A line whose key has at least ``min_chars`` code points and stands in at least
      ``min_docs`` documents is dropped, in all its places, from every document but
      the one with the largest id. All other lines stay, joined by ``\\n``.
    * Rows with one id are one document; a NULL id is one document, the smallest.
    * An empty table gives an empty result; other columns are not looked at.

    Keys are compared by 128 bits of hash. The corpus is added in ``batches``, dealt
    by id, and anti-joined when all counts are in.
    """
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    lines = store(long_lines(docs, min_chars).select("*", batch), "lines", "batch")
    runs = LineRuns(docs.sparkSession, fanout)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i))
    kept = runs.unrepeated(lines.drop("batch"), min_docs)
    places = kept.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("kept_pos")).select(
        F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "kept_pos"
    )
    places = store(places, "places")
    runs.drop()
    split = docs.select("doc_id", "text", row_digest(docs).alias("row"))
    found = split.join(
        places, split["doc_id"].eqNullSafe(places["_id"]) & (split["row"] == places["_row"]), "left"
    )
    parts = found.select("doc_id", "kept_pos", text_lines(found).alias("lines"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    long = F.filter(every, lambda i: _is_long(F.get("lines", i), min_chars))
    parts = parts.withColumn(
        "dropped", F.array_except(long, F.coalesce("kept_pos", F.array().cast("array<int>")))
    )
    parts = parts.withColumn("stay", F.array_except(every, F.col("dropped")))
    return parts.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size("dropped").cast("bigint").alias("n_dropped"),
        F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n").alias("kept_text"),
    )
