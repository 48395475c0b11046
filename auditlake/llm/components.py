"""Connected components by alternating large-star and small-star on an edge table.

Each star step finds the least neighbour of a node by a partial aggregate, writes these minima and joins them
back to the edges. No neighbour list is ever built, and as both sides of the join come from shuffles of tables,
adaptive execution splits a node with very many edges. Edges are written between steps; once they are stars,
the components are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash

#: Edges that one task may write; small graphs take few tasks, whatever the number of shuffle partitions.
EDGES_PER_TASK = 100_000


def _is_star(edges: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child: then parents are the components."""
    ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _parents(edges: DataFrame) -> DataFrame:
    """Edges with the larger end as child, each once."""
    return edges.where("child <> parent").select(F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent")).distinct()


def large_star(edges: DataFrame, stash: Stash, tasks: int) -> DataFrame:
    """Larger neighbours of a node move to its least neighbour (or itself, if that is less)."""
    least = edges.select(F.col("child").alias("node"), F.col("parent").alias("low")).unionByName(edges.select(F.col("parent").alias("node"), F.col("parent").alias("low")))
    low = stash.put(least.groupBy("node").agg(F.min("low").alias("low")), tasks)
    out = stash.put(edges.join(low.withColumnRenamed("node", "parent"), "parent").select("child", F.col("low").alias("parent")), tasks)
    stash.drop(low)
    return out


def small_star(edges: DataFrame, stash: Stash, tasks: int) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    low = stash.put(edges.groupBy("child").agg(F.min("parent").alias("low")), tasks)
    moved = edges.join(low, "child").select(F.col("parent").alias("child"), F.col("low").alias("parent"))
    out = stash.put(_parents(moved.unionByName(low.select("child", F.col("low").alias("parent")))), tasks)
    stash.drop(low)
    return out


def components(edges: DataFrame, stash: Stash, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node that has an edge to another one; component is the least node of its class.

    Null ends and loops are no edges; edges may repeat and come in either direction; no edges, no rows.
    """
    table = stash.put(_parents(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("child"), F.col(b).alias("parent"))))
    tasks = max(12, table.count() // EDGES_PER_TASK)
    while not _is_star(table):
        larger = large_star(table, stash, tasks)
        new = small_star(larger, stash, tasks)
        stash.drop(table, larger)
        table = new
    roots = table.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return table.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(roots)
