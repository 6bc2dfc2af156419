"""Databases, external tables and partitions in the session catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from daybook import schemas


def _columns(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create the database if needed and make it current."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{where}")
    spark.sql(f"USE `{name}`")


def drop_tables(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def create_external_table(spark: SparkSession, name: str, schema: StructType, path: str) -> None:
    """Table over existing Parquet files; dropping it leaves the files."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_columns(schema)}) USING PARQUET LOCATION '{path}'"
    )


def create_partitioned_table(
    spark: SparkSession,
    name: str,
    schema: StructType,
    path: str,
    partition: str = schemas.EVENT_PARTITION,
) -> None:
    """External table with a text partition key; ``repair_partitions`` fills it."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({_columns(schema)}, `{partition}` string) "
        f"USING PARQUET PARTITIONED BY (`{partition}`) LOCATION '{path}'"
    )


def repair_partitions(spark: SparkSession, name: str) -> None:
    """Register the partition directories found at the table's location."""
    spark.sql(f"MSCK REPAIR TABLE {name}")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    return spark.sql("SHOW TABLES" + (f" IN `{database}`" if database else ""))


def list_partitions(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {name}")


def publish_views(frames: Mapping[str, DataFrame]) -> None:
    """Name each frame as a temporary view."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def register_raw_layer(spark: SparkSession, database: str, folder: str) -> None:
    """Recreate the four raw tables of ``database`` over ``folder/<table>``."""
    ensure_database(spark, database, f"{folder.rstrip('/')}/_{database}")
    drop_tables(spark, *schemas.TABLES)
    for name, schema in schemas.TABLES.items():
        path = f"{folder.rstrip('/')}/{name}"
        if name == "ods_todo_event_log":
            create_partitioned_table(spark, name, schema, path)
            repair_partitions(spark, name)
        else:
            create_external_table(spark, name, schema, path)
