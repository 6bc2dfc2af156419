"""Left join of a fact table to a dimension, safe for hot and missing keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single join task should see at most.
ROWS_PER_SPLIT = 1_000_000

# Parts that keys are dealt to by hash where heavy ones are looked for.
KEY_PARTS = 1 << 16

# Size of a source that does not tell it.
UNKNOWN_BYTES = 1 << 62


def source_bytes(df: DataFrame, pruned: bool = True) -> int:
    """Size of what ``df`` reads, from Catalyst's statistics.

    An upper guide to the size of a frame that filters, projects, aggregates or
    looks up its sources without multiplying their rows. Frames built from
    local rows report Spark's "unknown" size, which counts as large. With
    ``pruned`` the plan is optimized first, so that partition filters and, in a
    plan without joins, the columns read count too.
    """
    query = df._jdf.queryExecution()
    plan = query.optimizedPlan() if pruned else query.analyzed()
    leaves = plan.collectLeaves()
    total = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    # Catalyst multiplies the sides of a join, so its total is the smaller one
    # only where there is none.
    return min(total, int(plan.stats().sizeInBytes()) if pruned else total, UNKNOWN_BYTES)


def broadcast_limit(df: DataFrame) -> int:
    """The session's ``autoBroadcastJoinThreshold`` in bytes (negative: never)."""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    text = text.strip().lower().removesuffix("b")
    units = {"k": 1024, "m": 1024**2, "g": 1024**3}
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def fits_broadcast(dim: DataFrame, limit: int | None = None) -> bool:
    """Whether the sources of ``dim`` are within the broadcast limit, by the whole
    files and by the plan's own estimate."""
    limit = broadcast_limit(dim) if limit is None else limit
    return all(source_bytes(dim, pruned) <= limit for pruned in (False, True))


def key_counts(df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows per key, as ``lookup_join`` takes them."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _crowded(keyed: DataFrame, limit: int) -> DataFrame:
    """Rows of ``keyed`` whose ``name`` and ``part`` have more than ``limit`` rows.

    A key cannot have more rows than its part, one of ``KEY_PARTS`` by hash. Rows of a
    task combine to so many at most, however many keys there are.
    """
    counted = keyed.groupBy("name", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    parts = counted.select("name", "part").collect()
    if not parts:
        return keyed.filter("false")
    listed = keyed.sparkSession.createDataFrame(parts, keyed.select("name", "part").schema)
    return keyed.join(F.broadcast(listed), ["name", "part"], "left_semi")


def heavy_keys(
    df: DataFrame, keys: Sequence[str], rows_per_split: int = ROWS_PER_SPLIT, nulls: bool = False
) -> dict[str, DataFrame]:
    """For each of ``keys`` its values with more rows than ``rows_per_split``, as ``counts``
    of ``lookup_join``, with ``nulls`` NULL as well. All are counted in one scan of ``df``
    and stored; keys themselves are shuffled only where a part of them has as many rows."""
    if not keys:
        return {}
    named = [F.struct(F.lit(k).alias("name"), F.col(k).cast("string").alias("key")) for k in keys]
    keyed = df.select(F.inline(F.array(*named))).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(KEY_PARTS)))
    keyed = _crowded(keyed if nulls else keyed.filter("key IS NOT NULL"), rows_per_split)
    counted = keyed.groupBy("name", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows_per_split)
    heavy = _stored(counted)
    return {
        k: heavy.filter(F.col("name") == k).select(F.col("key").cast(df.schema[k].dataType).alias(k), "n")
        for k in keys
    }


def heavy_counts(df: DataFrame, on: Sequence[str], rows_per_split: int) -> DataFrame:
    """``key_counts`` of the keys with more than ``rows_per_split`` rows, none of them NULL."""
    present = df.filter(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in on)))
    hashed = F.pmod(F.xxhash64(*on), F.lit(KEY_PARTS))
    keyed = present.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(on)], F.lit("").alias("name"), hashed.alias("part"))
    crowded = _crowded(keyed, rows_per_split)
    return key_counts(crowded.select(*[F.col(f"_{i}").alias(k) for i, k in enumerate(on)]), on)


def _stored(df: DataFrame) -> DataFrame:
    from daybook.session import scratch_path

    path = scratch_path(df.sparkSession, "keys")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    spread: str | Sequence[str] | None,
    counts: DataFrame | None = None,
    split_nulls: bool = False,
    broadcast_bytes: int | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """``fact LEFT JOIN dim USING (on)``, planned by the measured input sizes.

    * dimension within the broadcast limit: broadcast it, no shuffle;
    * no ``spread``: plain shuffled join;
    * otherwise: shuffled join in which the heaviest keys are salted over
      several tasks, their dimension rows being copied once per salt. The keys are
      counted and stored while the plan is made; their list is broadcast, so that the
      fact is shuffled once, by key and salt.

    ``spread`` names fact columns that vary within a key; the salt is a hash of
    them, so a retried task deals its rows the same way. None means that a key
    has few rows in ``fact`` by construction, and nothing is salted. ``counts``
    may give the rows per key, or an upper bound (columns ``on`` + ``n``).

    Rows without a key match nothing. They are dealt to all tasks, or with
    ``split_nulls`` kept out of the shuffle, at the price of a second scan:
    right for a stored fact table in which they are many.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(dim, broadcast_bytes):
        return fact.join(F.broadcast(dim), keys, "left")
    if spread is None:
        return fact.join(dim, keys, "left")
    spread = [spread] if isinstance(spread, str) else list(spread)
    if counts is None:
        counts = heavy_counts(fact, keys, rows_per_split)
    keyless = F.expr(" OR ".join(f"`{k}` IS NULL" for k in keys))
    hot = _hot_keys(counts.filter(~keyless), keys, rows_per_split)
    if not split_nulls:
        return _salted_left_join(fact, dim, keys, spread, hot, keyless)
    added = [
        F.lit(None).cast(f.dataType).alias(f.name) for f in dim.schema if f.name not in keys
    ]
    matched = _salted_left_join(fact.filter(~keyless), dim, keys, spread, hot, keyless)
    return matched.unionByName(fact.filter(keyless).select("*", *added))


def _hot_keys(counts: DataFrame, keys: list[str], rows_per_split: int) -> DataFrame | None:
    """Every key of more rows than one task should see, and the number of tasks it is
    dealt to; None if there is none.

    There are at most (all rows / ``rows_per_split``) of them, a million in 10^12 rows.
    Their stored size is measured: within the broadcast limit the list is broadcast,
    beyond it the join is left to Spark, which splits skewed partitions itself.
    """
    hot = _stored(
        counts.filter(F.col("n") > rows_per_split)
        .select(*keys, F.ceil(F.col("n") / rows_per_split).cast("bigint").alias("_splits"))
    )
    if hot.isEmpty():
        return None
    return F.broadcast(hot) if source_bytes(hot) <= broadcast_limit(hot) else hot


def _salted_left_join(
    fact: DataFrame, dim: DataFrame, keys: list[str], spread: list[str], hot: DataFrame | None, keyless
) -> DataFrame:
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    dealt_to = F.xxhash64(*spread)
    if hot is None:
        dealt = fact.withColumn("_salt", F.when(keyless, dealt_to).otherwise(zero))
        return dealt.join(dim.withColumn("_salt", zero), [*keys, "_salt"], "left").drop("_salt")
    dealt = fact.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(keyless, dealt_to)
        .when(F.col("_splits").isNotNull(), F.pmod(dealt_to, F.col("_splits")))
        .otherwise(zero),
    )
    copies = dim.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(zero, F.coalesce("_splits", one) - one))
    )
    joined = dealt.drop("_splits").join(copies.drop("_splits"), [*keys, "_salt"], "left")
    return joined.drop("_salt")
