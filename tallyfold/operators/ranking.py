"""Ranks and cuts: the first rows of each key, ranks without one large task, caps, interleaving, shares among peers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, nth: str | None = None) -> DataFrame:
    """The first n rows of each key; Spark keeps only n of a key in each task before the shuffle."""
    name = nth or "nth"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if nth else out.drop(name)


def ranked_top(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of all with their rank: cut to n before the numbering, so one task numbers n rows at most."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: str, name: str) -> DataFrame:
    """The sum of `n` over the rows of a key that stand before a row in order. No task needs all rows of a key: rows are dealt by ranges, summed within them, and ranges are added up, of which a key has as many as there are partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    # Written with its range: sampled bounds may differ when a plan runs again.
    dealt = cut_lineage(df.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("_within", F.coalesce(F.sum(n).over(before.partitionBy("_range", *keys).orderBy(*order)), F.lit(0)))
    ranges = dealt.groupBy("_range", *keys).agg(F.sum(n).alias("_n"))
    above = ranges.withColumn("_above", F.coalesce(F.sum("_n").over(before.partitionBy(*keys).orderBy("_range")), F.lit(0))).drop("_n")
    above = above.select(F.col("_range").alias("_of"), *[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], "_above")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_of"))
    return within.join(above, same).withColumn(name, F.col("_within") + F.col("_above")).drop("_range", "_within", "_above", "_of", *[f"_of_{i}" for i in range(len(keys))])


def global_rank(df: DataFrame, score: str, ties: str, rank: str = "rank") -> DataFrame:
    """The rank of every row by score, highest first, without a task that sees all rows."""
    one = df.withColumn("_one", F.lit(1))
    return running_total(one, [], [F.desc(score), F.col(ties)], "_one", "_before").withColumn(rank, F.col("_before") + 1).drop("_one", "_before")


def capped(df: DataFrame, outer: Sequence[str], inner: Sequence[str], order: Sequence[Column], most_inner: int, most_outer: int) -> DataFrame:
    """At most so many rows of each inner key, then at most so many of each outer key, first by order."""
    return top_per(top_per(df, [*outer, *inner], order, most_inner), outer, order, most_outer)


def interleaved(df: DataFrame, group: str, order: Sequence[Column], picks: Column, budget: int) -> DataFrame:
    """Round robin over groups, best first; a group gets `picks` rows a round; cut at the budget. A row beyond the budget in its own group can't come before it, so no more of a group is numbered."""
    numbered = top_per(df, [group], order, budget, nth="nth")
    return numbered.withColumn("round", F.ceil(F.col("nth") / picks).cast("long")).orderBy("round", group, "nth").limit(budget)


def share_below(df: DataFrame, peers: Sequence[str], value: str, name: str = "share_below") -> DataFrame:
    """The share of a row's peers whose value is strictly below its own: counts of distinct values, summed in order, joined back."""
    counts = cut_lineage(df.groupBy(*peers, value).agg(F.count(F.lit(1)).alias("_n")), "counts")
    below = running_total(counts, peers, [F.col(value)], "_n", "_below").select(*peers, value, "_below")
    totals = counts.groupBy(*peers).agg(F.sum("_n").alias("_total"))
    return df.join(below, [*peers, value]).join(totals, list(peers)).withColumn(name, F.col("_below") / F.col("_total")).drop("_below", "_total")
