"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a minimum per node (combined before the shuffle) joined back to the edges, so no node's
neighbours are ever gathered in one place; a hub's edges can be split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import written


EDGES_A_TASK = 100_000


def _star(edges: DataFrame, tasks: int) -> DataFrame:
    """One large-star and one small-star step over edges with a > b, in so many tasks at most."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
    large = both.where("v > u").join(least, "u").coalesce(tasks).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)
    least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
    small = large.join(least, "a").coalesce(tasks)
    small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return small.where("a > b").distinct().coalesce(tasks)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge, root being the smallest node of its component.

    edges has two integer columns; null ends and loops are dropped. An empty table gives an empty one.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    state = None
    while True:
        edges = written(edges, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
        edges = _star(edges, 1 + now[0] // EDGES_A_TASK)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select("b", "b").distinct())
