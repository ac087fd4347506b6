"""The signal store: fingerprints, idempotent upserts, pruning of superseded readings, de-duplication, snapshot differences, hash samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_per


def fingerprint(source: Column, kind: Column, ident: Column, url: Column, day: Column, subject: Column, continuous: Column) -> Column:
    """One identity for a fact: of a point event source, kind, entity, evidence and day; of a continuous reading source, kind, entity and subject."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    point = F.concat_ws("|", s(source), s(kind), s(ident), s(url), s(day))
    reading = F.concat_ws("|", s(source), s(kind), s(ident), s(subject))
    return F.substring(F.sha2(F.when(continuous, reading).otherwise(point).cast("binary"), 256), 1, 32)


def upsert(store: DataFrame, batch: DataFrame, key: str = "fingerprint", run: str = "run_id", seen: str = "observed_at") -> DataFrame:
    """One row a key: the latest run's values (of one run the greatest row), with the earliest time it was seen. The batch twice changes nothing."""
    both = store.unionByName(batch, allowMissingColumns=True)
    values = [c for c in both.columns if c not in (key, seen)]
    latest = F.max(F.struct(F.col(run), *[F.col(c) for c in values if c != run])).alias("latest")
    out = both.groupBy(key).agg(latest, F.min(seen).alias(seen))
    return out.select(*[F.col(c) if c in (key, seen) else F.col(f"latest.{c}").alias(c) for c in both.columns])


def upsert_counts(store: DataFrame, batch: DataFrame, key: str = "fingerprint") -> DataFrame:
    """(emitted, inserted) of a batch."""
    fresh = batch.select(key).distinct().join(store.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("inserted"))
    return batch.agg(F.count(F.lit(1)).alias("emitted")).crossJoin(fresh)  # one row each


def prune_superseded(df: DataFrame, keys: Sequence[str], continuous: Column, order: Sequence[Column]) -> DataFrame:
    """Of continuous readings of one subject the latest; all else stays. Only the readings are shuffled."""
    keep = F.coalesce(continuous, F.lit(False))
    return df.filter(~keep).unionByName(top_per(df.filter(keep), keys, order))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per(df, keys, order)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change): added, removed or updated, for rows that differ."""
    a = old.select(F.col(key), F.struct(*columns).alias("was"))
    b = new.select(F.col(key), F.struct(*columns).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "updated")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter(F.col("change").isNotNull())


def hash_sample(df: DataFrame, column: str, one_in: int = 64) -> DataFrame:
    """The same one in so many keys of every snapshot, by crc32."""
    return df.filter(F.crc32(F.col(column).cast("string").cast("binary")) % one_in == 0)


def merged_feeds(*feeds: DataFrame, key: str, moment: str) -> DataFrame:
    """Several feeds as one; a key that repeats counts where it was seen latest."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(moment)))).filter(F.col("_nth") == 1).drop("_nth")
