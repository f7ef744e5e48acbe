"""Connected components by hooking to the smallest neighbour and contracting.

Per round every node still in play hooks onto its smallest neighbour (if smaller than
itself), one pointer jump shortens the trees, and the edges are rewritten between the
new representatives. The smallest node of a component always hooks onto itself, so the last
representative left is the component's minimum. The number of rounds grows with the
logarithm of the longest chain. A node with very many edges (a star's centre) is only met in
a partial aggregation and in joins whose skewed partitions adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import dropped, written


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b), component being the
    smallest node reachable. Self-loops are allowed, rows with a null end are ignored."""
    e = edges.select("a", "b").filter("a is not null and b is not null")
    current = written(e, "edges")
    labels = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        hooks = first = written(hooks, "hooks")
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("root"))
        hooks = written(hooks.join(above, "up").select("node", "root"), "roots")
        if labels is None:
            labels = hooks.select("node", F.col("root").alias("component"))
        else:
            moved = hooks.select(F.col("node").alias("component"), "root")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        before, labels = labels, written(labels, "labels")
        ra, rb = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = current.filter("a != b").join(ra, "a").join(rb, "b").filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        previous, current = current, written(left, "edges")
        dropped(first, hooks, before, previous)  # the next round reads labels and edges alone
        if current.isEmpty():
            dropped(current)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
