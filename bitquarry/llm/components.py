"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def forest(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Component labels of ``n`` vertices joined by (rows, cols)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, label[rows], low)
        np.minimum.at(new, label[cols], low)
        while (new != new[new]).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def connected(edges: DataFrame) -> DataFrame:
    """``id, component`` of every end of ``edges(a, b)``; the component is its smallest id.

    Rounds of hooking and contraction: every vertex hooks to its smallest
    neighbour, chains are shortened by pointer jumping until all point to a
    root, and the links are redrawn between roots until none is left.  Each
    round at least halves the vertices that still have links.  Everything stays
    in tables of the shared folder; rows without two different ends are ignored.
    """
    left = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels: DataFrame | None = None
    while True:
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("parent")))
        while True:
            up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
            jumped = checkpoint(parent.join(up, "parent").select("id", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")))
            parent = jumped.select("id", "parent")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("id", F.col("parent").alias("component"))
        else:
            up = parent.select(F.col("id").alias("component"), "parent")
            labels = checkpoint(labels.join(up, "component", "left").select("id", F.coalesce("parent", "component").alias("component")))
        of = lambda end: parent.select(F.col("id").alias(end), F.col("parent").alias(f"{end}_root"))
        drawn = left.join(of("a"), "a").join(of("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        left = checkpoint(drawn.filter("a < b").distinct())
        if left.isEmpty():
            return labels
