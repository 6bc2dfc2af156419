"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import store


def _is_star(links: DataFrame) -> bool:
    """Whether every node has one link to its root, and no root has a link."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("child")).unionByName(
        links.select(F.col("b").alias("n"), F.lit(0).alias("child"))
    )
    seen = ends.groupBy("n").agg(F.sum("child").alias("c"), F.min("child").alias("m"))
    return seen.filter("c > 1 OR (c = 1 AND m = 0)").isEmpty()


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: nodes move to smaller neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = (
        both.join(least, "a").filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
    )
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    moved = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node but the roots; ``root`` is the least of a component.

    ``links`` has ``a, b`` (no NULL). Nodes are moved to smaller neighbours until
    all of a component hang on one root, in rounds of a number that grows with the
    logarithm of the longest chain. Each round is written to the shared folder.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = store(links.distinct(), "links")
    while not _is_star(links):
        links = store(_round(links), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
