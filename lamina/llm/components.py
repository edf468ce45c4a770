"""Connected components of an edge table, by rounds of joins and groupings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node of its component.

    ``edges`` has two columns of one orderable type. Each round links every node's larger neighbours to its smallest
    one, then its smaller neighbours too, until the graph is a star around each root (a few rounds for groups of
    copies). Rounds are written to shared scratch; the driver sees two numbers of each.
    """
    a, b = edges.columns
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = materialize(both.where("u <> v").distinct())
    state = None
    for _ in range(max_rounds):
        around = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == (seen.n, seen.x):
            break
        state = (seen.n, seen.x)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over edges (u, v), within one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new
