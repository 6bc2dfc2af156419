"""Small inputs shared by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook import schemas

LOG = (
    "log_id string, user_id string, session_id string, event_time string, event_type string, "
    "task_id string"
)


def event_log(spark, *events):
    """Contract log from (id, user, session, time, type, task) tuples."""
    df = spark.createDataFrame(list(events), LOG)
    for name in schemas.EVENT_LOG.names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df.select(*schemas.EVENT_LOG.names)


def users(spark, *ids, **columns):
    df = spark.createDataFrame([(i,) for i in ids], "user_id string")
    for field in schemas.DIM_USER.fields[1:]:
        df = df.withColumn(field.name, F.lit(columns.get(field.name)).cast(field.dataType))
    return df


def tasks(spark, *values):
    """Task dimension from dictionaries; what is not named is NULL."""
    names = schemas.DIM_TASK.names
    return spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], schemas.DIM_TASK)


def collect(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
