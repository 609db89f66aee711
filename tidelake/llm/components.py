"""Connected components by random hooking.

Each round every node hooks onto its neighbour of least priority, edges move to
the hooked nodes, and loops and repeats go.  Priorities are hashes drawn anew
each round, so long paths shrink by a constant factor in expectation.  Only
tables move: no component, however large, is gathered anywhere.  Each round's
tables are saved in the shared folder, which cuts the lineage, and joins read
saved tables directly, so that Spark can split the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) to one row (node, component) for each node with an edge; a component is one of its nodes."""
    edges = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(hooks))
        both = edges.union(edges.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64(seed, "b").alias("h"), "b")).alias("best"))
        own = F.struct(F.xxhash64(seed, "node").alias("h"), F.col("node").alias("b"))
        hook = scratch.save(nearest.select("node", F.least(own, "best")["b"].alias("parent")), "hooks")
        hooks.append(hook)
        moved = edges.join(hook.withColumnsRenamed({"node": "a", "parent": "pa"}), "a").join(hook.withColumnsRenamed({"node": "b", "parent": "pb"}), "b")
        before, edges = edges, scratch.save(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        scratch.drop(before)
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = hooks[0].withColumnRenamed("parent", "component")
    for hook in hooks[1:]:
        later = hook.withColumnsRenamed({"node": "component", "parent": "next"})
        found = found.join(later, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    found = scratch.save(found, "components")
    scratch.drop(edges, *hooks)
    return found
