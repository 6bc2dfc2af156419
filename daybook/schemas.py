"""Declared schemas of the raw contract tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampNTZType,
)

TYPES = {
    "string": StringType(), "boolean": BooleanType(), "int": IntegerType(),
    "bigint": LongType(), "double": DoubleType(), "timestamp_ntz": TimestampNTZType(),
}


def columns(text: str) -> StructType:
    """Schema from ``name type, name type, …`` (needs no running session)."""
    pairs = (part.split() for part in text.split(","))
    return StructType([StructField(name, TYPES[kind.lower()]) for name, kind in pairs])


DIM_USER = columns(
    "user_id STRING, register_time STRING, user_group STRING, user_level STRING, "
    "user_type STRING, gender STRING, age_group STRING, province STRING, city STRING, "
    "is_active BOOLEAN, register_channel STRING"
)
DIM_DATE = columns(
    "date_key STRING, date_str STRING, year INT, month INT, day INT, week_of_year INT, "
    "day_of_week INT, is_weekend INT, is_holiday INT"
)
DIM_TASK = columns(
    "task_id STRING, user_id STRING, list_id STRING, task_title STRING, priority STRING, "
    "due_date STRING, create_time STRING, complete_time STRING, is_completed BOOLEAN, "
    "has_subtask BOOLEAN, has_reminder BOOLEAN, task_status STRING"
)
EVENT_LOG = columns(
    "log_id STRING, user_id STRING, session_id STRING, event_time STRING, "
    "event_type STRING, task_id STRING, list_id STRING, attributes STRING, "
    "device_type STRING, os STRING, app_version STRING, network_type STRING"
)
EVENT_PARTITION = "event_date"

TABLES = {
    "dim_user": DIM_USER,
    "dim_date": DIM_DATE,
    "dim_task": DIM_TASK,
    "ods_todo_event_log": EVENT_LOG,
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: fail on missing columns, cast widths."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
