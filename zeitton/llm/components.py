"""Connected components as rounds of joins, with every round stored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from zeitton.session import stage


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of ``n`` indices reaches by the given links, inside one task."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(hop := root[root], root):
            root = hop
        open_links = root[left] != root[right]
        left, right = left[open_links], right[open_links]
    return root


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``a, b``, bigint): the root is the component's smallest node.

    Rounds hang the larger neighbours of every node on its smallest one, then the smaller neighbours,
    until nothing changes. Minima are combined before the shuffle and stored; the join of a node with
    very many neighbours is then one that adaptive execution splits. Each round ends as a stored table.
    """
    same, previous = F.col("a") == F.col("b"), None
    current = stage(
        edges.where(~same).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == previous:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        previous = mark
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "least")
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stage(large.where(~same).distinct(), "edges")
        low = stage(large.groupBy("a").agg(F.min("b").alias("low")), "least")
        small = large.join(low, "a")
        hung = small.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        current = stage(hung.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
