"""Connected components of a graph given as edges: union-find by rounds of joins.

Alternating rounds of large-star and small-star: every node links its larger neighbours to the least
node it knows, then its smaller ones. Each round is one grouping of edges; the number of rounds grows
with the logarithm of the longest path. A node with very many neighbours is no burden on one task:
the least neighbour is a partial minimum, and only a join brings it to the edges, which adaptive
execution may split. Edges of each round are a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.session import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a, b) with a > b, after one round."""
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:  # larger neighbours go to the least node around
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # a node and its smaller neighbours go to the least of them
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of the component.

    Edges may repeat, run either way, or join a node to itself; such a node is its own root.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _summary(now)
    while True:
        now = stage(_star(_star(now, True), False), "edges")
        before, state = state, _summary(now)
        if state == before:
            break
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))


def _summary(edges: DataFrame) -> tuple:
    """Equal before and after a round only if nothing changed; sums of hashes, a number each."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least node of each node's component, in one task: labels sink along links until none changes."""
    roots = np.arange(n)
    while len(left):
        low = np.minimum(roots[left], roots[right])
        new = roots.copy()
        np.minimum.at(new, roots[left], low)
        np.minimum.at(new, roots[right], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, roots):
            break
        roots = new
        differ = roots[left] != roots[right]
        left, right = left[differ], right[differ]
    return roots
