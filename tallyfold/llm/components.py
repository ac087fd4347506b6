"""Connected components of a table of links, by alternating large-star and small-star rounds of joins and aggregations.

No group is gathered anywhere: a node's least neighbour is an aggregate, and the links take it by a join,
whose hot keys adaptive execution splits. Each round is written to the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else both.filter(F.col("b") <= F.col("a"))
    # Written, so that the join below stands on two plain shuffles, whose hot keys adaptive execution can split.
    least = written(side.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
    joined = (both.filter(F.col("b") > F.col("a")) if large else side).join(least, "a")
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that a link (a, b) names; root is the least node that can be reached."""
    links = written(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    before = None
    while True:
        links = written(_star(_star(links, large=True), large=False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def joined(label: np.ndarray, links_: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its tree) after links between places join their trees."""
    while True:
        a, b = label[links_[0]], label[links_[1]]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
