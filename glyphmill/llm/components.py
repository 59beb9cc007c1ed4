"""Connected components by alternating large-star and small-star steps, with DataFrame functions only.

Each step keeps the components and brings every node nearer to its smallest
member; the number of rounds grows with the logarithm of the longest path.
Only scalars reach the driver.  Each round's minima are written, so that the
joins with hubs of many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, scratch


def _minima(edges: DataFrame) -> DataFrame:
    return scratch(edges.groupBy("u").agg(F.min("v").alias("m")), "star").select(F.col("u").alias("w"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both).select("w", F.least("w", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    low = _minima(down)
    others = down.join(low, F.col("u") == F.col("w")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (u, v) but those that are smallest themselves."""
    now, before = scratch(edges.where("u <> v").distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum((F.col("v") % 1_000_003))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, old = state, now
        now = scratch(_small_star(_large_star(now).distinct()).distinct(), "edges")
        drop_scratch(old)
