"""A row among rows of like rank: a band of ranks around its own, clipped to the nearest on both sides, without a task that sees all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut_lineage
from .ranking import running_total


def stretches(df: DataFrame, rank: str, by: str, key: str, band: float = 1.5, nearest: int | None = 4000) -> tuple[DataFrame, DataFrame]:
    """(place, k, by, r) of all rows in order of rank, `by` and key, from place 0 on; and (r, low, high) of each rank: the places low to high - 1 of its rows' cohort.

    A cohort has the ranks within a factor of `band` of a row's own, and of these at most half of `nearest` below the first row of its rank and half from there on. Rows without a rank are left out; `key` tells rows apart. Rows of a rank are counted first, so ends are looked for a rank, not a row."""
    rows = df.filter(F.col(rank).isNotNull()).select(F.col(rank).cast("double").alias("_r"), F.col(key).alias("_k"), F.col(by).alias("_q"))
    ranks = cut_lineage(rows.groupBy("_r").agg(F.count(F.lit(1)).alias("_c")), "ranks")
    one = lambda x, kind, n: ranks.select(x.alias("_x"), F.lit(kind).alias("_kind"), n.cast("long").alias("_n"), "_r")
    order = [F.col("_x"), F.col("_kind"), F.col("_r")]
    r, c, none = F.col("_r"), F.col("_c"), F.lit(0)
    # How many ranks times the band are below a rank; how many ranks are below it; how many are at most it times the band.
    low = running_total(one(r, 0, none).unionByName(one(r * band, 1, c)), [], order, "_n", "_at").filter("_kind = 0").select("_r", F.col("_at").alias("_low"))
    asked = one(r, -1, none).unionByName(one(r, 0, c)).unionByName(one(r * band, 1, none))
    at = running_total(asked, [], order, "_n", "_at").filter("_kind <> 0")
    ends = at.groupBy("_r").agg(F.max(F.when(F.col("_kind") == -1, F.col("_at"))).alias("_mid"), F.max(F.when(F.col("_kind") == 1, F.col("_at"))).alias("_high")).join(low, "_r")
    if nearest is not None:
        ends = ends.withColumn("_low", F.greatest("_low", F.col("_mid") - nearest // 2)).withColumn("_high", F.least("_high", F.col("_mid") + nearest // 2))
    places = running_total(rows.withColumn("_n", F.lit(1)), [], [F.col("_r"), F.col("_q"), F.col("_k")], "_n", "_place").drop("_n")
    return cut_lineage(places, "places"), cut_lineage(ends.select("_r", "_low", "_high"), "stretches")


#: Places of a task's piece of the list at least, and rows that ask it at once.
PIECE, ASKED = 1 << 15, 1 << 16


def smaller(values: np.ndarray, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
    """How many of values[low:high] are smaller than a number, of many stretches at once. Values and numbers are whole and not below 0. They are split bit by bit, highest first, into those without the bit and those with it (a wavelet matrix), so a stretch takes a step a bit, however long it is."""
    found = np.zeros(len(low), np.int64)
    for bit in range(int(max(values.max(initial=0), than.max(initial=0))).bit_length() - 1, -1, -1):
        ones = (values >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        has = (than >> bit & 1).astype(bool)
        a, z = zeros[low], zeros[high]
        found += np.where(has, z - a, 0)
        low, high = np.where(has, zeros[-1] + low - a, a), np.where(has, zeros[-1] + high - z, z)
        values = np.concatenate([values[~ones], values[ones]])
    return found


def _below_near(rows: DataFrame, nearest: int) -> DataFrame:
    """(k, below) of rows (place, k, q, low, high) whose stretches have `nearest` places at most. The list is cut into pieces that have as many places of the next one too, so that each stretch is within one; a piece that many rows ask, as those of one rank do, is sent to several tasks."""
    width = max(PIECE, nearest)
    asked = rows.filter("_low < _high").withColumn("_piece", F.floor(F.col("_low") / width))
    parts = cut_lineage(asked.groupBy("_piece").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("_parts")), "pieces")
    asked = asked.join(F.broadcast(parts), "_piece").select("_piece", F.pmod(F.xxhash64("_k"), F.col("_parts")).cast("int").alias("_part"), "_k", "_q", "_low", "_high")
    own = F.floor(F.col("_place") / width)
    before = F.when((own > 0) & (F.col("_place") % width < nearest), F.array(own, own - 1)).otherwise(F.array(own))
    points = rows.select(F.explode(before).alias("_piece"), "_place", "_q").join(F.broadcast(parts), "_piece")
    points = points.select("_piece", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(None).cast(rows.schema["_k"].dataType).alias("_k"), "_q", F.col("_place").alias("_low"), F.lit(None).cast("long").alias("_high"))

    def run(table: pa.Table) -> pa.Table:
        q = table.column("_q").combine_chunks()
        none = q.is_null().to_numpy(zero_copy_only=False)
        # Nulls come first, as Spark sorts them.
        code = np.zeros(len(q), np.int64)
        code[~none] = np.unique(q.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)[1] + 1
        asks = table.column("_high").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        low = table.column("_low").to_numpy()
        at = np.flatnonzero(~asks)[np.argsort(low[~asks])]
        high = table.column("_high").combine_chunks().drop_null().to_numpy()
        first = low[at[0]]
        found = smaller(code[at], low[asks] - first, high - first, code[asks])
        return pa.table([table.column("_k").filter(pa.array(asks)), pa.array(found)], names=["_k", "below"])

    return asked.unionByName(points).groupBy("_piece", "_part").applyInArrow(run, T.StructType([rows.schema["_k"], T.StructField("below", T.LongType())]))


def cohort_share(df: DataFrame, rank: str, ratio: str, key: str, band: float = 1.5, least: int = 200, nearest: int | None = 4000) -> DataFrame:
    """df with cohort (how many rows it has) and share: of the cohort's rows those with a smaller ratio; null with fewer than `least` rows.

    A cohort is a stretch of places. With `nearest`, rows meet the piece of the list that their stretch is in. Without, no row meets its cohort: a stretch is a few blocks of 1, 2, 4 ... places, at most two of each size, and what a block has
    below a ratio is a running total over the block's rows in order of ratio, so rows and stretches make some 3 log n rows in all."""
    places, ends = stretches(df, rank, ratio, key, band, nearest)
    stretch = places.join(ends, "_r")
    if nearest is not None:
        stretch = cut_lineage(stretch, "asked")
        return _shared(df, key, stretch, _below_near(stretch, nearest), least)
    levels = range(max(1, places.count().bit_length()))
    block = lambda level, at: F.struct(F.lit(level).alias("_level"), at.cast("long").alias("_block"))
    left, right = lambda k: F.ceil(F.col("_low") / 2**k), lambda k: F.floor(F.col("_high") / 2**k)
    ends = [(F.when((left(k) < right(k)) & (left(k) % 2 == 1), block(k, left(k))), F.when((left(k) < right(k)) & (right(k) % 2 == 1), block(k, right(k) - 1))) for k in levels]
    blocks = F.filter(F.array(*[e for pair in ends for e in pair]), lambda e: e.isNotNull())
    asked = stretch.select("_k", "_q", F.explode(blocks).alias("_b")).select("_k", "_q", "_b.*", F.lit(0).alias("_kind"), F.lit(0).alias("_n"))
    points = places.select("_k", "_q", F.explode(F.array(*[block(k, F.floor(F.col("_place") / 2**k)) for k in levels])).alias("_b")).select("_k", "_q", "_b.*", F.lit(1).alias("_kind"), F.lit(1).alias("_n"))
    below = running_total(asked.unionByName(points), ["_level", "_block"], [F.col("_q"), F.col("_kind"), F.col("_k")], "_n", "_below")
    return _shared(df, key, stretch, below.filter("_kind = 0").groupBy("_k").agg(F.sum("_below").alias("below")), least)


def _shared(df: DataFrame, key: str, stretch: DataFrame, found: DataFrame, least: int) -> DataFrame:
    found = stretch.select("_k", (F.col("_high") - F.col("_low")).alias("cohort")).join(found, "_k", "left").withColumn("below", F.coalesce("below", F.lit(0)))
    return df.join(found.withColumnRenamed("_k", key), key).withColumn("share", F.when(F.col("cohort") >= least, F.col("below") / F.col("cohort")))


def entrant_rate(df: DataFrame, rank: str, is_new: str, key: str, band: float = 1.5, least: int = 200, nearest: int | None = 4000) -> DataFrame:
    """df with cohort and rate: the share of a row's cohort that is new, from sums up to both ends of its stretch; null with fewer than `least` rows. A null flag counts as not new."""
    flagged = df.withColumn("_flag", F.coalesce(F.col(is_new).cast("int"), F.lit(0)))
    places, stretch = stretches(flagged, rank, "_flag", key, band, nearest)
    sums = cut_lineage(running_total(places.withColumnRenamed("_q", "_n"), [], [F.col("_place")], "_n", "_before"), "sums")
    # What stands before each end that any row asks for; the end behind the last row has all.
    upto = sums.select(F.col("_place").alias("_end"), "_before").unionByName(sums.agg(F.count(F.lit(1)).alias("_end"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_before")))
    at = lambda end, name: upto.select(F.col("_end").alias(end), F.col("_before").alias(name))
    both = stretch.join(at("_low", "_from"), "_low").join(at("_high", "_to"), "_high").join(places, "_r")
    found = both.select(F.col("_k").alias(key), (F.col("_high") - F.col("_low")).alias("cohort"), (F.col("_to") - F.col("_from")).alias("new"))
    return df.join(found, key).withColumn("rate", F.when(F.col("cohort") >= least, F.col("new") / F.col("cohort")))
