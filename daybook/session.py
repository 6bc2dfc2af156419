"""Session settings the package is written for."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from daybook.functions.lookups import UNKNOWN_BYTES, source_bytes

# Input bytes per shuffle partition before adaptive execution merges small ones.
PARTITION_BYTES = 128 * 1024 * 1024

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Join by hash table instead of sorting where every partition is this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Call sites per column expression double the time to build a wide plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def build_session(name: str = "daybook", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the package's settings; ``conf`` overrides (dots as ``__``)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is absent and the session is local (as in tests) is a
    folder of this machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/daybook-{uuid.uuid4().hex}/{name}"


def size_shuffles(spark: SparkSession, *sources: DataFrame) -> int:
    """Raise ``spark.sql.shuffle.partitions`` to suit the size of the sources.

    Adaptive execution joins partitions that turn out small but splits only
    skewed joins, so the number has to be large enough from the start.
    """
    present = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [source_bytes(df) for df in sources]
    # Sources of unknown size say nothing about the number.
    known = [size for size in sizes if size < UNKNOWN_BYTES]
    partitions = max(math.ceil(sum(known) / PARTITION_BYTES), present)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return partitions
