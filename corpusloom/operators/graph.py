"""Property-graph patterns as equi-joins, and checks of references against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def join_any_key(left: DataFrame, right: DataFrame, key: str, keys: tuple[str, ...]) -> DataFrame:
    """`key` equals any of `keys`: one equi-join each instead of an OR, which would compare all pairs."""
    found = None
    for i, k in enumerate(keys):
        own = left.join(right, left[key] == right[k])
        for before in keys[:i]:
            # pairs that an earlier key has joined; equal rows of `left` all stay
            own = own.where(~F.coalesce(left[key] == right[before], F.lit(False)))
        found = own if found is None else found.unionByName(own)
    return found


def confidence(checks: Column) -> Column:
    """Passed weight by weight of (passed, weight) structs; 0.5 without checks."""
    total = lambda f: F.aggregate(checks, F.lit(0.0), lambda a, x: a + f(x))
    return F.when(F.size(checks) == 0, 0.5).otherwise(F.coalesce(F.try_divide(total(lambda x: F.when(x["passed"], x["weight"]).otherwise(0.0)), total(lambda x: x["weight"])), F.lit(0.0)))


def prefixes(name: Column, mark: str) -> Column:
    """All leading parts of a dotted name, so that a prefix join is an equi-join."""
    parts = F.split(name, f"\\{mark}")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), mark))


def reach(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node, level): breadth-first levels over (src, dst), from `start` (node), visited nodes left out.

    Edges and each level are written once, so a level costs one join, however deep it is.
    """
    edges = stored(edges, "edges")
    level = start.select("node").distinct().withColumn("level", F.lit(0))
    seen = level
    for i in range(1, depth + 1):
        level = level.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(i))
        level = stored(level, "level")
        seen = seen.unionByName(level)
    return seen
