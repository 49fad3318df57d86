"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges that a task of a step writes; steps never add edges, so the first count holds for all.
TASK_EDGES, LEAST_TASKS = 100_000, 8


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); the component is its smallest node.

    Each step is a grouping by node with a partial minimum and a join, so no task holds the
    neighbours of a node; the number of steps grows with the logarithm of the longest path.
    It ends once no component's smallest node has a smaller neighbour itself.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tasks = max(LEAST_TASKS, now.count() // TASK_EDGES)

    def step(found: DataFrame, name: str) -> DataFrame:
        return materialise(found.where("a <> b").distinct().coalesce(tasks), name)

    while True:
        # large star: neighbours above a node meet its smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = step(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        # small star: neighbours below a node, and itself, meet its smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = step(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))), "small")
        # stars only: every node has one neighbour below it, which has none
        if now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
