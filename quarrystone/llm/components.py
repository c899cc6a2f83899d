"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.work import Work


def connected_components(links: DataFrame, work: Work, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has a link; component is the smallest node reachable.

    `links` has columns a and b. Alternates the large-star and the small-star step (Kiveris et al.,
    "Connected Components in MapReduce and Beyond", 2014) until the links no longer change; links and
    labels stay in tables. A node with many links is spread: minima are pre-aggregated, and the joins
    are ones whose large partitions Spark splits. Self-links and nulls are ignored.
    """
    step = lambda df: df.distinct()
    now = work.put(step(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), f"{name}-0")
    before = _digest(now)
    for i in range(1, rounds + 1):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = step(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v")))
        now = work.put(step(small), f"{name}-{i}")
        work.drop(f"{name}-{i - 1}")
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _digest(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
