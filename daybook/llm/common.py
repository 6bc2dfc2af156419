"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of the contracts, as a regular expression and as characters.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Digits, a-z and all bytes of characters beyond ASCII stand for themselves, A-Z for
# a-z, every other byte for a blank. Bytes of longer characters are all above 127, so
# UTF-8 text stays whole.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
# Bytes of a text that are split at once.
TEXT_PIECE = 1 << 20


def word_lists(raw: bytes, piece: int = TEXT_PIECE) -> Iterator[list[bytes]]:
    """The words of ``WORD_TABLE`` in a text, in order; a long text gives several lists,
    so that its words need not all be in memory."""
    blank = raw.translate(WORD_TABLE)
    start = 0
    while start < len(blank):
        end = blank.find(b" ", start + piece) if start + piece < len(blank) else -1
        end = len(blank) if end < 0 else end
        yield blank[start:end].split()
        start = end


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of this machine only where
    the setting is absent and driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


def store(df: DataFrame, name: str, *partition: str, compression: str = "snappy") -> DataFrame:
    """Write a step's rows to the shared folder and return the frame that reads them.

    Cuts the lineage: a lost executor costs the tasks since this table only, and
    what follows sees the same rows however often it runs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Bytes of an Arrow batch of blocks; the block that passes them is the last one.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Steps run inside get rows of megabytes a few at a time, not all of a task at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def running_total(
    df: DataFrame, keys: Sequence[str], part: str, order: Sequence[Column], **totals: str
) -> DataFrame:
    """Running sums over each ``keys`` group in the order of (``part``, ``order``).

    ``totals`` maps a result column to the SQL expression that it sums, the row
    itself included. ``part`` cuts a group into consecutive pieces that fit one
    task: the sums run inside the pieces, and one row for each piece carries the
    total of the pieces before it. No group meets in one task. ``part`` is not
    NULL and must be a function of the row, so that both passes agree.
    """
    inner = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = df.groupBy(*keys, part).agg(
        *(F.sum(F.expr(value)).alias(f"_{name}") for name, value in totals.items())
    )
    offsets = pieces.select(
        *(F.col(k).alias(f"_key_{i}") for i, k in enumerate([*keys, part])),
        *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals),
    )
    summed = df.withColumns({n: F.sum(F.expr(v)).over(inner) for n, v in totals.items()})
    match = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate([*keys, part])]
    joined = summed.join(offsets, match)
    return joined.select(
        *df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in totals)
    )


def row_digest(docs: DataFrame) -> Column:
    """Tells the rows of one id apart by their text."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def packed_rows(docs: DataFrame, *by: str) -> DataFrame:
    """``row, doc_id, digest, copy`` and the ``by`` columns: whole rows packed, so that no
    name of theirs can clash. ``copy`` numbers rows of one id, text and ``by`` from 1
    in the order of their other columns."""
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    rest = [docs[c].cast("string") for c in docs.columns if c not in ("doc_id", "text", *by)]
    rows = docs.select(
        row, "doc_id", row_digest(docs).alias("digest"), *by, F.array(F.lit(None).cast("string"), *rest).alias("rest")
    )
    copy = F.row_number().over(Window.partitionBy("doc_id", "digest", *by).orderBy("rest"))
    return rows.withColumn("copy", copy).drop("rest")


def pick_rows(docs: DataFrame, chosen: DataFrame, copies: bool = False) -> DataFrame:
    """The rows of ``docs`` with a (``doc_id``, ``digest``) of ``chosen``, all columns;
    of rows that repeat both one, or with ``copies`` all."""
    keys = chosen.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_key"))
    rows = packed_rows(docs)
    if not copies:
        rows = rows.filter("copy = 1")
    found = rows.join(
        keys, rows["doc_id"].eqNullSafe(keys["_id"]) & (rows["digest"] == keys["_key"]), "left_semi"
    )
    return found.select("row.*")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


class Shelf:
    """Tables bucketed by a key for the steps of one job: joins on the key leave them
    in place. ``clear`` takes them out of the catalog; their files stay with the
    other checkpoints in the shared folder."""

    def __init__(self, spark: SparkSession, key: str):
        self.spark, self.key = spark, key
        self.buckets = shuffle_partitions(spark)
        self.tables: list[str] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        table = f"llm_{name}_{uuid.uuid4().hex[:12]}"
        (
            df.write.format("parquet").option("compression", "zstd")
            .option("path", scratch_path(self.spark, name))
            .bucketBy(self.buckets, self.key).saveAsTable(table)
        )
        self.tables.append(table)
        return self.spark.table(table)

    def clear(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []
