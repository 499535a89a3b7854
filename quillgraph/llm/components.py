"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step joins and aggregates links by vertex; a hub's links are aggregated in their tasks first and its join is
one that adaptive execution can split. The links after each round are a stage table, so lineage stays short. The
driver sees a count and a checksum a round, no links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, stage


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = down.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.toDF("a", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b, two numbers each) to (id, component): for each vertex of a link the smallest it reaches."""
    now = stage(_small_star(links), "links")
    state = _state(now)
    while True:
        following = stage(_small_star(_large_star(now)), "links")
        drop(now)
        now, before, state = following, state, _state(following)
        if state == before:
            break
    return now.union(now.select("b", "b")).distinct().toDF("id", "component")


def extend(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` (id, component) after more ``links``, as a stage table; only links between different
    components take part."""
    at = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"_{side}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    moved = components(ends.where("a <> b"))
    known = found.union(moved.select("id", "id")).distinct()
    joined = known.join(moved.toDF("component", "_to"), "component", "left")
    return stage(joined.select("id", F.coalesce("_to", "component").alias("component")).distinct(), "components")
