"""Named tables that are replaced whole, ``CREATE OR REPLACE TABLE name AS``.

Every build is written as a table of its own, ``<name>__v<number>_<random>``. The name
is a view of one of them and is moved to the new one in a single step of the catalog
once the build is complete. A reader meets the old rows or the new ones, with the columns
and partitions that belong to them; a build that fails leaves the name where it was.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(r"__v(\d+)_[0-9a-f]{8}$")
_PROPERTY = "daybook.version"


def _split(name: str) -> tuple[str, str]:
    database, _, table = name.rpartition(".")
    return (f"`{database}`." if database else ""), table


def _versions(spark: SparkSession, name: str) -> dict[int, str]:
    """Complete versions of ``name`` by number."""
    prefix, table = _split(name)
    where = f" IN {prefix[:-1]}" if prefix else ""
    rows = spark.sql(f"SHOW TABLES{where} LIKE '{table}__v*'").collect()
    found = ((r.tableName, _VERSION.search(r.tableName)) for r in rows)
    return dict(sorted((int(m[1]), t) for t, m in found if m and t[: m.start()] == table.lower()))


def current_version(spark: SparkSession, name: str) -> int | None:
    """Number of the version that ``name`` shows; None where there is no such name."""
    if not spark.catalog.tableExists(name):
        return None
    prefix, table = _split(name)
    rows = spark.sql(f"SHOW TBLPROPERTIES {prefix}`{table}`").collect()
    numbers = [int(r.value) for r in rows if r.key == _PROPERTY]
    if not numbers:
        raise ValueError(f"{name} is not a versioned table")
    return numbers[0]


def _point(spark: SparkSession, name: str, number: int, version: str) -> None:
    prefix, table = _split(name)
    spark.sql(
        f"CREATE OR REPLACE VIEW {prefix}`{table}` TBLPROPERTIES ('{_PROPERTY}' = '{number}') "
        f"AS SELECT * FROM {prefix}`{version}`"
    )


def replace_table(df: DataFrame, name: str, partition: Sequence[str] = (), keep: int = 2) -> int:
    """Make ``df`` the rows of ``name``, a table of the current or the named database, and
    return the number of the new version.

    Columns and ``partition`` may differ from version to version. ``df`` may read ``name``
    itself. The ``keep`` newest versions stay, so that readers that have begun on the one
    before can finish; older ones are dropped with their files.
    """
    spark = df.sparkSession
    current_version(spark, name)  # refuses a name that is something else
    prefix, table = _split(name)
    number = max(_versions(spark, name), default=0) + 1
    version = f"{table}__v{number:06d}_{uuid.uuid4().hex[:8]}".lower()
    writer = df.write.format("parquet").mode("errorifexists")
    if partition:
        writer = writer.partitionBy(*partition)
    writer.saveAsTable(f"{prefix}`{version}`")
    _point(spark, name, number, version)
    drop_versions(spark, name, keep)
    return number


def restore_version(spark: SparkSession, name: str, number: int) -> None:
    """Show an older version under ``name`` again."""
    _point(spark, name, number, _versions(spark, name)[number])


def read_version(spark: SparkSession, name: str, number: int) -> DataFrame:
    return spark.table(f"{_split(name)[0]}`{_versions(spark, name)[number]}`")


def drop_versions(spark: SparkSession, name: str, keep: int) -> list[int]:
    """Drop all but the ``keep`` newest versions and the one shown."""
    versions, shown = _versions(spark, name), current_version(spark, name)
    old = [n for n in list(versions)[: -keep or None] if n != shown]
    for number in old:
        spark.sql(f"DROP TABLE IF EXISTS {_split(name)[0]}`{versions[number]}`")
    return old


def list_versions(spark: SparkSession, name: str) -> DataFrame:
    """``version, is_current, row_cnt`` of every version that is kept."""
    shown = current_version(spark, name)
    frames = [
        read_version(spark, name, n).agg(F.count(F.lit(1)).alias("row_cnt")).select(
            F.lit(n).alias("version"), F.lit(n == shown).alias("is_current"), "row_cnt"
        )
        for n in _versions(spark, name)
    ]
    out = spark.createDataFrame([], "version int, is_current boolean, row_cnt bigint")
    for frame in frames:
        out = out.unionByName(frame)
    return out
