"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def spanning_edges(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Of these edges, as stars to the smallest node, a forest with the same components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = sorted(parent)
    return nodes, [find(x) for x in nodes]


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, component), the smallest node reachable.

    Only nodes that have an edge appear.  Each round is two combinable
    aggregates and joins, written to the shared folder; nothing is collected
    but a count and a checksum.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written out, so that the join shuffles by itself and Spark can split a star's centre.
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = materialize(low, "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialize(large.distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = materialize(small, "edges")
        after = _state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = after
