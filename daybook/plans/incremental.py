"""What a build has read, so that the next one reads only what has changed.

The manifest of a build holds the files of every directory of the raw log, the days, users
and tasks that each directory's events belong to, and a digest of every dimension row.
From it, the listing of the log and the dimensions, the next build knows which event days
are to be made again and which directories hold them; all other directories stay unread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook import schemas
from daybook.sources import files

FILES = "event_date string, file string, length bigint, modified timestamp"
KEYS = "event_day date, kind string, key string, event_date string"
ROWS = "kind string, key string, digest decimal(38,0), n bigint"
# Dimensions whose rows are part of the joined events, by key.
DIMENSIONS = {"user": ("dim_user", "user_id"), "task": ("dim_task", "task_id")}


def event_day() -> Column:
    """The day of a raw event, by its time and not by its directory."""
    return F.col("event_time").cast("timestamp_ntz").cast("date")


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """``event_date, file, length, modified`` of a day-partitioned log, without opening a file."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select(
        F.col(schemas.EVENT_PARTITION).cast("string").alias("event_date"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def day_keys(log: DataFrame) -> DataFrame:
    """``event_day, kind, key, event_date``: the event days in each directory, and the users
    and tasks of their events, each once."""
    rows = log.withColumn("event_day", event_day())
    kinds = {"day": F.lit(None).cast("string"), **{k: F.col(key).cast("string") for k, (_, key) in DIMENSIONS.items()}}
    out = None
    for kind, key in kinds.items():
        some = rows.select("event_day", F.lit(kind).alias("kind"), key.alias("key"), "event_date").distinct()
        some = some if kind == "day" else some.filter("key IS NOT NULL")
        out = some if out is None else out.unionByName(some)
    return out


def dimension_rows(raw: dict) -> DataFrame:
    """``kind, key, digest, n``: the rows of each dimension key by the sum of their hashes.

    Hashes skip NULLs, so the hash also covers which columns are NULL.
    """
    out = None
    for kind, (table, key) in DIMENSIONS.items():
        dim = raw[table]
        row = F.xxhash64(*[F.col(c) for c in dim.columns], *[F.col(c).isNull() for c in dim.columns])
        some = dim.groupBy(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key")).agg(
            F.sum(row.cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest"), F.count(F.lit(1)).alias("n")
        )
        out = some if out is None else out.unionByName(some)
    return out


@dataclass
class Changes:
    """Event days to make again (None: events without a time), directories that hold them,
    and directories that are new to the manifest."""

    days: set
    directories: set[str]
    renewed: set[str]

    def filter(self, log: DataFrame) -> DataFrame:
        """The raw events of ``days``; only ``directories`` are read."""
        day = event_day()
        chosen = day.isin([d for d in self.days if d is not None])
        if None in self.days:
            chosen |= day.isNull()
        return log.filter(F.col("event_date").isin(sorted(self.directories))).filter(chosen)


class Manifest:
    """The manifest of the builds in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, raw: dict, log_path: str):
        self.spark, self.folder, self.raw, self.log_path = spark, folder.rstrip("/"), raw, log_path

    def _stored(self, name: str, ddl: str) -> DataFrame:
        return files.read_or_empty(self.spark, f"{self.folder}/{name}", ddl)

    def _renewed(self, days: tuple[str, str]) -> set[str] | None:
        """Directories of ``days`` and those whose files differ; None if one has gone."""
        now, had = log_files(self.spark, self.log_path), self._stored("files", FILES)
        differ = now.exceptAll(had).unionByName(had.exceptAll(now)).select("event_date").distinct()
        present = {r[0] for r in now.select("event_date").distinct().collect()}
        changed = {r[0] for r in differ.collect()}
        if changed - present:
            return None
        return changed | {d for d in present if days[0] <= d <= days[1]}

    def changes(self, days: tuple[str, str]) -> Changes | None:
        """What to make again when the directories of ``days`` are taken as new; None where
        everything is: without a manifest, or when a directory or a whole day has gone."""
        had = self._stored("keys", KEYS)
        if had.isEmpty():
            return None
        renewed = self._renewed(days)
        if renewed is None:
            return None
        log = self.raw["ods_todo_event_log"].filter(F.col("event_date").isin(sorted(renewed)))
        new, old = day_keys(log), had.filter(F.col("event_date").isin(sorted(renewed)))
        others = had.filter(~F.col("event_date").isin(sorted(renewed)))
        rows = self._stored("rows", ROWS)
        changed = dimension_rows(self.raw)
        changed = changed.exceptAll(rows).unionByName(rows.exceptAll(changed)).select("kind", "key").distinct()
        of_rows = others.join(changed, ["kind", "key"], "left_semi")
        # One row for each pair of an event day and a directory from here on.
        pairs = {
            name: {(r[0], r[1]) for r in df.select("event_day", "event_date").distinct().collect()}
            for name, df in {
                "new": new.filter("kind = 'day'"), "old": old.filter("kind = 'day'"),
                "others": others.filter("kind = 'day'"), "of_rows": of_rows,
            }.items()
        }
        touched = {day for name in ("new", "old", "of_rows") for day, _ in pairs[name]}
        held = pairs["new"] | pairs["others"]
        if touched - {day for day, _ in held}:
            return None
        return Changes(touched, {d for day, d in held if day in touched}, renewed)

    def store(self, changes: Changes | None) -> None:
        """Write down what has been read, after all tables are stored: a build that failed
        leaves the manifest as it was, and the next one finds the same changes."""
        log = self.raw["ods_todo_event_log"]
        if changes is not None:
            log = log.filter(F.col("event_date").isin(sorted(changes.renewed)))
        if changes is None or changes.renewed:
            files.write_partitioned(day_keys(log), f"{self.folder}/keys", keep_others=changes is not None)
        files.write_table(dimension_rows(self.raw), f"{self.folder}/rows")
        files.write_table(log_files(self.spark, self.log_path), f"{self.folder}/files")
