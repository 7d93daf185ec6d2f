"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a min-aggregate per node joined back to its edges, so that a node with very many
neighbours is pre-aggregated and its join can be split; no group of neighbours is ever collected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Edges that one task may hold.
SMALL = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them; edges point downwards."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _by_union(edges: DataFrame) -> DataFrame:
    """(node, component) of a graph small enough for one task."""

    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
                parent[max(a, c)] = min(a, c)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, component bigint")


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """edges(u, v) of longs -> (node, component), component being the smallest node reachable.

    Loops and repeated edges are allowed; nodes without another one linked to them are left out. At most
    `small` distinct edges are joined up by one task, without the rounds that any other number takes.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct())
    if now.limit(small + 1).count() <= small:
        return cut(_by_union(now))
    while True:
        big = cut(_large_star(now))
        after = cut(_small_star(big))
        discard(big)
        discard(now)
        now = after
        # stars: every node below has one parent, and no parent is below another node
        count, nodes = now.agg(F.count("*"), F.count_distinct("u")).first()
        if count == nodes and now.select("u").join(now.select(F.col("v").alias("p")), F.col("u") == F.col("p"), "left_semi").isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
