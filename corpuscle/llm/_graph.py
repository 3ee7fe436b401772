"""Connected components on DataFrames, and a union-find for bounded groups within a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


class Forest:
    """Union-find over 0 .. n-1; the smaller number becomes the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


#: Edges that one task joins at once (16 bytes each).
SMALL = 400_000


def _joined(t: pa.Table) -> pa.Table:
    """Every node of the edges with the smallest node of its component."""
    nodes, inv = np.unique(np.concatenate((t["a"].to_numpy(), t["b"].to_numpy())), return_inverse=True)
    forest, n = Forest(len(nodes)), len(t)
    for x, y in zip(inv[:n].tolist(), inv[n:].tolist(), strict=True):
        forest.join(x, y)
    root = nodes[[forest.root(x) for x in range(len(nodes))]]
    away = root != nodes
    return pa.table({"from": nodes[away], "to": root[away]})


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node of its component) of every node of ``edges(a, b)``.

    Each round hands every node to its smallest smaller neighbour, follows these
    steps to their ends (each pass doubles their length) and contracts the edges to
    the ends; contracted edges that are loops or repeats go.  Every node that is
    left in a round stands for two of the round before at least, so rounds and
    passes grow with the logarithm of the size, and a forest of stars takes one.
    Once ``SMALL`` edges or fewer are left, one task joins them.  The smallest node of
    a component is never handed on, so it is the label.

    What a join reads is cut off before, so that both sides are plain exchanges
    and the engine can split the partition of a hub.  Nothing but counts comes to the
    driver.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    steps = []
    while now.count() > SMALL:
        step = cut(now.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("from"), F.col("m").alias("to"), F.lit(True).alias("on")))
        while not step.where("on").isEmpty():
            up = step.select(F.col("from").alias("u"), F.col("to").alias("um"))
            step = cut(step.join(up, F.col("to") == F.col("u"), "left").select("from", F.coalesce("um", "to").alias("to"), F.col("um").isNotNull().alias("on")))
        step = step.drop("on")
        steps.append(step)
        second = step.select(F.col("from").alias("from2"), F.col("to").alias("to2"))
        moved = now.join(step, F.col("a") == F.col("from")).select("b", F.col("to").alias("x"))
        moved = moved.join(second, F.col("b") == F.col("from2"), "left").select("x", F.coalesce("to2", "b").alias("y"))
        now = cut(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    steps.append(cut(now.groupBy(F.lit(0).alias("all")).applyInArrow(_joined, "from long, to long")))
    out = nodes.withColumn("label", F.col("node"))
    for step in steps:
        out = out.join(step, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut(out)
