"""Connected components of a table of links, and joins that survive hot groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch


SHARE = 20_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Alternates two star steps: every node passes the smallest neighbour it knows to its larger
    neighbours, then to its smaller ones. Each step only aggregates minima and joins by node, so no
    neighbourhood is ever collected; the rounds grow with the logarithm of the longest chain.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = scratch(links.filter("a != b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = scratch(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        new = scratch(small.select("e.*").filter("a != b").distinct(), "edges")
        after = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop_scratch(large)
        drop_scratch(edges)
        edges = new
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row per group.

    Groups whose ``size`` is over a part in ``SHARE`` of ``total``, the number of rows, are at most ``SHARE`` short rows,
    so they are broadcast and their rows never meet in one task. A smaller group is less than a shuffle
    partition of a large table should hold, and adaptive execution splits what is more.
    """
    hot = F.col(size) > F.lit(max(1, total // SHARE))
    rest = [c for c in groups.columns if c not in keys]
    first = rows.join(F.broadcast(groups.filter(hot)), keys, "left")
    light = first.filter(F.col(size).isNull()).drop(*rest).join(groups.filter(~hot), keys, "left")
    return first.filter(F.col(size).isNotNull()).unionByName(light)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each by the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
