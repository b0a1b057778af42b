"""Connected components by alternating large-star and small-star steps.

Every step is a few equi-joins and grouped minima over the edges, which are written to the shared
folder after each round. Nodes are longs. A round more than halves the longest path, so rounds grow
with the logarithm of the data. Nothing but two numbers a round reaches the driver. Up to ``ONE_TASK``
edges (half a megabyte) are joined up by a single task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import Scratch

ONE_TASK = 1 << 15


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label over the links a-b, and over all links merged before."""
    while True:
        la, lb = label[a], label[b]
        if np.array_equal(la, lb):
            return label
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while not np.array_equal(label, up := label[label]):
            label = up


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b[["hi", "lo"]].to_numpy() for b in batches]
    if parts:
        edges = np.concatenate(parts)
        node, at = np.unique(edges, return_inverse=True)
        at = at.reshape(edges.shape)
        label = merge_labels(np.arange(len(node)), at[:, 0], at[:, 1])
        yield pd.DataFrame({"node": node, "root": node[label]})


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns a, b -> node, root: the smallest node reachable, for every node that has an edge.

    The result is a table in the shared folder.
    """
    work = Scratch(edges.sparkSession, "components")
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = work.put(edges)
    before = _mark(edges)
    if before[0] <= ONE_TASK:
        found = work.put(edges.coalesce(1).mapInPandas(_together, "node long, root long"))
        work.clear(found)
        return found
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        # written before each join: Spark then splits the rows of a node with very many edges
        least = work.put(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # an edge's own larger end keeps its smallest neighbour
        large = work.put(large.union(edges.select("hi", "lo").groupBy("hi").agg(F.min("lo").alias("lo"))).distinct())
        small = work.put(large.groupBy("hi").agg(F.min("lo").alias("m")))
        moved = large.join(small.withColumnRenamed("hi", "k"), F.col("hi") == F.col("k")).filter("lo <> m").select("lo", "m")
        edges = work.put(small.union(moved).toDF("hi", "lo").distinct())
        work.clear(edges)
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = work.put(edges.groupBy("hi").agg(F.min("lo").alias("lo")).select(F.col("hi").alias("node"), F.col("lo").alias("root")))
    work.clear(found)
    return found
