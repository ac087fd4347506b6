"""What came before: prior counts, first flags, ordinals, as-of lookups, unbroken runs, densest windows, trailing counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from .lineage import cut_lineage
from .ranking import running_total


def days(d: Column | str) -> Column:
    return F.unix_date(F.col(d) if isinstance(d, str) else d)


def _by_moment(df: DataFrame, keys: Sequence[str], moment: str, before: Column, name: str) -> DataFrame:
    """df with `before` (an aggregate of a key's rows at one moment), summed over the key's earlier moments. Rows become one a moment first. Days of a key are as many as the calendar has at most; sums over other moments go by ranges, so no task has a party's whole history."""
    at = df.groupBy(*keys, F.col(moment).alias("_at")).agg(before.alias("_n"))
    if isinstance(df.schema[moment].dataType, DateType):
        earlier = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        sums = at.withColumn(name, F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    else:
        sums = running_total(at, keys, [F.col("_at")], "_n", name)
    sums = sums.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_at", name)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], F.col(moment).eqNullSafe(F.col("_at")))
    return df.join(sums, same).drop("_at", *[f"_{i}" for i in range(len(keys))])


def prior_counts(df: DataFrame, keys: Sequence[str], day: str, name: str = "prior") -> DataFrame:
    """Rows of the same party on strictly earlier days (rows without a day come first)."""
    return _by_moment(df, keys, day, F.count(F.lit(1)), name)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Mapping[str, str]) -> DataFrame:
    """Values of the row just before of the same key; columns maps new names to old. Rows are dealt by ranges of keys and order, so no task has a key's whole history: a range's first row of a key takes the last one of the nearest range before that has the key. Rows that `order` doesn't tell apart follow one another in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written with its range: sampled bounds may differ when a plan runs again.
    dealt = cut_lineage(df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range", *keys).orderBy(*order)
    told = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    within = cut_lineage(dealt.withColumn("_told", told).withColumn("_nth", F.row_number().over(own)).withColumn("_own", F.lag("_told").over(own)).withColumn("_last", F.lead(F.lit(1)).over(own).isNull()), "within")
    # A row a range and key.
    ends = within.filter("_last").select("_range", *keys, "_told")
    ends = ends.select(F.col("_range").alias("_of"), *[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)], F.lag("_told").over(Window.partitionBy(*keys).orderBy("_range")).alias("_before"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_of"))
    found = within.join(ends, same, "left")
    value = F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_own"))
    return found.select(*df.columns, *[value[new].alias(new) for new in columns])


def first_flag(df: DataFrame, keys: Sequence[str], order: Sequence[Column], complete: Column | None = None, name: str = "is_first") -> DataFrame:
    """First row of its key (one, even of rows that `order` doesn't tell apart); null where the key's history isn't complete. Counted by ranges, so no task has a key's whole history."""
    first = running_total(df.withColumn("_one", F.lit(1)), keys, order, "_one", "_earlier").withColumn("_first", F.col("_earlier") == 0).drop("_one", "_earlier")
    return first.withColumn(name, F.col("_first") if complete is None else F.when(complete, F.col("_first"))).drop("_first")


def ordinal(df: DataFrame, keys: Sequence[str], moment: str, name: str = "nth") -> DataFrame:
    """1 for the first distinct moment of a key, 2 for the next."""
    return _by_moment(df, keys, moment, F.max(F.lit(1)), name).withColumn(name, (F.col(name) + 1).cast("int"))


def islands(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Unbroken runs of days of each key: first, last, length."""
    one = df.select(*keys, F.col(day).alias("d")).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("d"))
    return one.withColumn("run", days("d") - nth).groupBy(*keys, "run").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("n_days")).drop("run")


def densest(df: DataFrame, keys: Sequence[str], day: str, k: int) -> DataFrame:
    """The most rows of a key in any k days in a row, and the first day of the earliest such stretch."""
    daily = df.groupBy(*keys, F.col(day).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(days("d")).rangeBetween(0, k - 1)
    return daily.withColumn("in_window", F.sum("n").over(w)).groupBy(*keys).agg(F.max("in_window").alias("densest"), F.min_by("d", F.struct(-F.col("in_window"), F.col("d"))).alias("from_day"))


def trailing(df: DataFrame, keys: Sequence[str], day: str, asof: Column, windows: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Counts of rows whose age in days is within [from, to) for each named window; one pass, one shuffle."""
    age = F.datediff(asof, F.col(day))
    return df.groupBy(*keys).agg(*[F.count(F.when((age >= a) & (age < b), 1)).alias(n) for n, (a, b) in windows.items()])


def acceleration(now: Column, before: Column) -> Column:
    return (now + 1) / (before + 1)


def first_batch(df: DataFrame, keys: Sequence[str], day: str, gap: int = 3) -> DataFrame:
    """Rows, rows within `gap` days of the first, and whether these make a birth: all of at least 3, half of at least 5, or 30 % of at least 10."""
    daily = cut_lineage(df.groupBy(*keys, F.col(day).alias("_day")).agg(F.count(F.lit(1)).alias("_n")), "daily")
    totals = daily.groupBy(*keys).agg(F.min("_day").alias("first_day"), F.sum("_n").alias("n"))
    early = F.when(F.datediff("_day", "first_day") <= gap, F.col("_n"))
    k, n = F.col("n_first"), F.col("n")
    marked = daily.join(totals, list(keys)).groupBy(*keys, "first_day", "n").agg(F.coalesce(F.sum(early), F.lit(0)).alias("n_first"))
    return marked.withColumn("is_birth", ((k == n) & (k >= 3)) | ((k >= 5) & (k >= 0.5 * n)) | ((k >= 10) & (k >= 0.3 * n)))


def nearest_snapshot(targets: DataFrame, target: str, snapshots: DataFrame, snap: str, reach: int = 3) -> DataFrame:
    """For each target day the snapshot day closest to it, at most `reach` days away; earlier first on ties. An equi-join over the few days in reach."""
    near = targets.withColumn("off", F.explode(F.array(*[F.lit(o) for o in sorted(range(-reach, reach + 1), key=lambda o: (abs(o), o))]))).withColumn("_day", F.date_add(F.col(target), F.col("off")))
    met = near.join(snapshots.select(F.col(snap).alias("_day")).distinct(), "_day")
    w = Window.partitionBy(target).orderBy(F.abs("off"), "off")
    return met.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).select(target, F.col("_day").alias("snapshot"), "off")


def weekly_counts(df: DataFrame, keys: Sequence[str], day: str, asof: Column, weeks: int) -> DataFrame:
    """Rows of each of the last `weeks` whole weeks that end at asof, week 0 the latest."""
    week = F.floor(F.datediff(asof, F.col(day)) / 7).cast("int")
    return df.withColumn("week", week).filter(F.col("week").between(0, weeks - 1)).groupBy(*keys, "week").agg(F.count(F.lit(1)).alias("n"))
