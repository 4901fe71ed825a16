"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node connected with each of n nodes, for edges a-b held in memory."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node connected with it) for every node of an edge.

    ``edges``: columns a, b (long). Large and small stars alternate: each node's
    neighbours are linked to its smallest neighbour, first those above the node, then
    those below, until nothing changes; the number of rounds grows with the logarithm
    of the longest path. A round's edges are written to the shared folder, which cuts
    the lineage; minima are taken before rows are exchanged and joined back, so no
    node's neighbours are gathered, and only a count and a checksum reach the driver.
    """
    low = F.least("a", "b").alias("a")
    now = written(edges.select(low, F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    mark = _mark(now)
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum("a")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    up = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return up.filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # b is the larger end: its neighbours below are all a
    least = edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "w")
    joined = edges.join(least, F.col("b") == F.col("w"))
    out = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), F.col("w").alias("b")))
    return out.filter("a < b").distinct()
