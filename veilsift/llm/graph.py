"""Lookups that stand hot keys, and connected components, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def look_up(rows: DataFrame, entries: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``entries`` (one row a key, ``weight`` rows on the other side).

    Keys with more rows than an even share of a task are at most as many as tasks; they go by
    broadcast, so their rows stay where they are. All others go by a shuffle.
    """
    tasks = common.partitions(rows.sparkSession)
    even = max(1, total // tasks)
    hot = entries.where(F.col(weight) > even)
    cold = entries.where(F.col(weight) <= even)
    named = F.broadcast(hot.select(*keys))
    by_hot = rows.join(F.broadcast(hot), keys)
    by_cold = rows.join(named, keys, "left_anti").join(cold, keys)
    return by_hot.unionByName(by_cold)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of non-null edges: (node, label), label the component's smallest node.

    Alternating large-star and small-star steps: a node's neighbours are linked to the smallest of
    them, first the larger ones, then the smaller ones, until each node points at its label. Each step
    takes a minimum with map-side combining; nodes with more edges than an even share of a task look
    it up by broadcast, so a hub's edges are never in one task. Every second step is written to the
    shared folder; edges never grow in number.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = common.stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = least.select("u", F.least("u", "m").alias("m"), "n")
        large = look_up(both.where("v > u"), least, ["u"], "n", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge points down from u to v now
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = look_up(large, least, ["u"], "n", 2 * before[0])
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = common.stored(small.where("u <> v").distinct(), "edges")
        common.forget(now)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
