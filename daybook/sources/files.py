"""Parquet and CSV sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from daybook import schemas

# Stands for NULL; the empty text is an empty field.
CSV_NULL = "\\N"
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, conform: bool = False
) -> DataFrame:
    """Parquet scan. With ``conform`` the stored types may differ from ``schema``:
    required columns are checked and cast to the declared types."""
    if schema is None:
        return spark.read.parquet(path)
    if conform:
        return schemas.conform(spark.read.parquet(path), schema)
    return spark.read.schema(schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Like ``read_table``, but a path that does not exist gives an empty frame."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_event_log(
    spark: SparkSession,
    path: str,
    date_from: str | None = None,
    date_to: str | None = None,
    schema: StructType | None = schemas.EVENT_LOG,
    partition: str = schemas.EVENT_PARTITION,
    time: str = "event_time",
) -> DataFrame:
    """Event log of some days (bounds inclusive), with its day as text.

    In a day-partitioned log the bounds prune whole partitions; the key is declared,
    so it stays text as in the catalog table. A flat log gets the day of its event
    time, and the bounds become time bounds that reach the scan. Without ``schema``
    the stored one is taken.
    """
    stored = spark.read.parquet(path)
    low, high = (None if d is None else F.lit(d).cast("date") for d in (date_from, date_to))
    if partition not in stored.columns:
        log = stored if schema is None else spark.read.schema(schema).parquet(path)
        moment = F.col(time).cast("timestamp_ntz")
        if low is not None:
            log = log.filter(moment >= low.cast("timestamp_ntz"))
        if high is not None:
            log = log.filter(moment < F.date_add(high, 1).cast("timestamp_ntz"))
        return log.withColumn(partition, F.date_format(moment, "yyyy-MM-dd"))
    if schema is None:
        schema = StructType([f for f in stored.schema if f.name != partition])
    log = spark.read.schema(StructType([*schema.fields]).add(partition, StringType())).parquet(path)
    if date_from is not None:
        log = log.filter(F.col(partition) >= date_from)
    if date_to is not None:
        log = log.filter(F.col(partition) <= date_to)
    return log


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_partitioned(
    df: DataFrame,
    path: str,
    partition: str = schemas.EVENT_PARTITION,
    rebalance: bool = True,
    keep_others: bool = True,
    order: Sequence[str] = (),
) -> None:
    """One directory per partition value; a rerun replaces only the days it holds,
    or with ``keep_others`` off the whole table.

    Rows are rebalanced by the partition value: small days come together, and a
    day too large for one task is split into several files. A frame whose tasks
    hold few days each already (a scan of a day-partitioned table) needs none. The
    rows of a file are in ``order``.
    """
    dealt = df.hint("rebalance", partition) if rebalance else df
    (
        (dealt.sortWithinPartitions(partition, *order) if order else dealt)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if keep_others else "static")
        .partitionBy(partition)
        .parquet(path)
    )


def publish(
    df: DataFrame, folder: str, name: str, partition: str | None = None, **options
) -> DataFrame:
    """Store a derived table and return the frame that reads the stored copy."""
    path = f"{folder.rstrip('/')}/{name}"
    if partition is None:
        write_table(df, path)
    else:
        write_partitioned(df, path, partition, **options)
    return read_published(df, folder, name, partition)


def publish_ordered(df: DataFrame, folder: str, name: str, order: Sequence[str]) -> DataFrame:
    """Like ``publish``, with rows in ``order`` inside and across the files: file after file
    holds the next range of the order, and readers skip files, and parts of them, by
    the least and greatest values kept with each.

    Rows are dealt by ranges of the order itself, so a frequent first value is split by
    the next columns.
    """
    write_table(df.repartitionByRange(*order).sortWithinPartitions(*order), f"{folder.rstrip('/')}/{name}")
    return read_published(df, folder, name)


def read_published(df: DataFrame, folder: str, name: str, partition: str | None = None) -> DataFrame:
    """The stored copy of ``df``, whose columns it has in their order; ``df`` is not run."""
    path = f"{folder.rstrip('/')}/{name}"
    if partition is None:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    stored = StructType([f for f in df.schema if f.name != partition]).add(df.schema[partition])
    return df.sparkSession.read.schema(stored).parquet(path).select(*df.columns)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; all fields quoted, NULL as ``CSV_NULL``, timestamps to the
    microsecond. Texts come back as they are: spaces at the ends, line breaks, quotes
    and backslashes too."""
    (
        df.write.mode("overwrite")
        .options(header=True, quoteAll=True, nullValue=CSV_NULL, emptyValue="", escape='"')
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
        .options(timestampFormat=CSV_TIME, timestampNTZFormat=CSV_TIME)
        .csv(path)
    )


def export_tables_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table of ``tables`` as CSV under ``folder/<name>``."""
    for name, df in tables.items():
        export_csv(df, f"{folder.rstrip('/')}/{name}")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return (
        spark.read.schema(schema)
        .options(header=True, nullValue=CSV_NULL, emptyValue="", escape='"', multiLine=True)
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .options(timestampFormat=CSV_TIME, timestampNTZFormat=CSV_TIME)
        .csv(path)
    )


def preview(df: DataFrame, n: int = 10, order: tuple[str, ...] = ()) -> DataFrame:
    """The first ``n`` rows, by ``order`` where given."""
    return (df.orderBy(*order) if order else df).limit(n)
