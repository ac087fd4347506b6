"""Keyed state: first sightings and latest readings that live in a value state with a timer for each key, and rows that come late or early."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.lineage import shared_place

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(spark: SparkSession) -> None:
    """Keyed state needs the store that keeps more than one state a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class _Sightings(StatefulProcessor):
    """Of each key: when it was first and last seen (in milliseconds), and whether the first was told."""

    def __init__(self, keys: list[str], moment: str, idle: int | None) -> None:
        self.keys, self.moment, self.idle = keys, moment, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, told boolean")

    def _wake(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        first, last, told = self.seen.get() if self.seen.exists() else (None, None, False)
        for part in rows:
            at = part[self.moment].astype("datetime64[us, UTC]" if part[self.moment].dt.tz is not None else "datetime64[us]").astype("int64") // 1000
            low, high = int(at.min()), int(at.max())
            if told and self.idle is not None and low - last > self.idle:
                first = last = None  # back after an idle time whose timer hasn't come up yet
                told = False
            first = low if first is None else first if told else min(first, low)
            last = high if last is None else max(last, high)
        self.seen.update((first, last, told))
        if not told:
            self._wake(first)
        elif self.idle is not None:
            self._wake(last + self.idle)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        first, last, told = self.seen.get()
        if told:
            self.seen.clear()
            yield pd.DataFrame()
            return
        self.seen.update((first, last, True))
        if self.idle is not None:
            self.handle.registerTimer(last + self.idle)
        yield pd.DataFrame({k: [v] for k, v in zip(self.keys, key, strict=True)} | {"first_seen": [pd.Timestamp(first, unit="ms")]})

    def close(self) -> None:
        pass


def sightings(events: DataFrame, keys: list[str], moment: str, late: str = "1 day", idle: int | None = None) -> DataFrame:
    """(keys, first_seen) of each key, told once, when the watermark has passed it, so that no row on time can still be earlier: the same in any order of arrival, and across restarts from a checkpoint.

    With `idle` (milliseconds) a key without rows for so long is dropped from the state and told anew if it comes back; without, it stays. Rows beyond the watermark count only for keys that
    are known. Null keys are a key of their own; rows without a moment are left out. Times are in milliseconds."""
    _keyed(events.sparkSession)
    fields = [events.schema[k] for k in keys] + [T.StructField("first_seen", T.TimestampType())]
    timed = events.filter(F.col(moment).isNotNull()).select(*keys, moment).withWatermark(moment, late)
    return timed.groupBy(*keys).transformWithStateInPandas(_Sightings(keys, moment, idle), T.StructType(fields), "Append", "EventTime")


class _Latest(StatefulProcessor):
    """Of each key the row of the latest moment, by a text that orders rows of one moment."""

    def __init__(self, keys: list[str], moment: str, columns: list[str], schema: T.StructType, idle: int | None) -> None:
        self.keys, self.moment, self.columns, self.schema, self.idle = keys, moment, columns, schema, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        best = self.latest.get() if self.latest.exists() else None
        before = best
        for part in rows:
            row = part.sort_values([self.moment, *self.columns]).iloc[-1]
            now = (row[self.moment].to_pydatetime(), *(getattr(row[c], "item", lambda c=c: row[c])() for c in self.columns))
            if best is None or tuple(best) <= now:
                best = now
        if best is before:
            yield pd.DataFrame()
            return
        self.latest.update(tuple(best))
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(pd.Timestamp(best[0]).timestamp() * 1000) + self.idle)
        yield pd.DataFrame({k: [v] for k, v in zip([*self.keys, self.moment, *self.columns], [*key, *best], strict=True)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self.latest.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def latest(events: DataFrame, keys: list[str], moment: str, columns: list[str], late: str = "1 day", idle: int | None = None) -> DataFrame:
    """(keys, moment, columns) of each key's latest row, told again whenever a later one comes; of rows of one moment the greatest columns win. With `idle` a key is forgotten so long after its latest row. Columns are numbers or texts without nulls; rows without a moment are left out."""
    _keyed(events.sparkSession)
    held = T.StructType([events.schema[c] for c in (moment, *columns)])
    fields = T.StructType([events.schema[c] for c in (*keys, moment, *columns)])
    timed = events.filter(F.col(moment).isNotNull()).select(*keys, moment, *columns).withWatermark(moment, late)
    return timed.groupBy(*keys).transformWithStateInPandas(_Latest(keys, moment, columns, held, idle), fields, "Append", "EventTime")


def sorted_by_lateness(events: DataFrame, source: str, moment: str, allowed: Mapping[str, int], otherwise: int, clock: Column, progress: str | None = None) -> DataFrame:
    """All rows of a stream with `arrival`: on time, late or held, run to its end. Every source has a watermark of its own: the latest moment it has shown in earlier batches, less the days that are `allowed` it (`otherwise` for sources not named).

    A row behind its source's watermark is late. One ahead of `clock` (a timestamp column) is held: it doesn't move the watermark, and each batch looks at held rows
    again and lets those go that are due, which are on time then. A row without source or moment is late. So each row is in the answer once, and none is lost.

    Per batch the latest moments (a row a source) and the held rows are written under the batch's number, read from the number before: a batch that is replayed writes the same again."""
    spark = events.sparkSession
    at = shared_place(spark, "lateness")
    seen = T.StructType([events.schema[source], T.StructField("_latest", T.TimestampType())])
    days = F.coalesce(*[F.when(F.col(source) == k, F.lit(v)) for k, v in allowed.items()], F.lit(otherwise)) if allowed else F.lit(otherwise)

    def sort(batch: DataFrame, epoch: int) -> None:
        known = spark.read.schema(seen).parquet(f"{at}/latest/{epoch - 1}") if epoch else spark.createDataFrame([], seen)
        was_held = spark.read.schema(events.schema).parquet(f"{at}/held/{epoch - 1}") if epoch else batch.limit(0)
        rows = batch.withColumn("_fresh", F.lit(True)).unionByName(was_held.withColumn("_fresh", F.lit(False)))
        behind = F.col(moment) < F.col("_latest") - F.make_interval(days=days)
        state = F.when(F.col(moment).isNull() | F.col(source).isNull(), "late").when(F.col(moment) > clock, "held").when(F.col("_fresh") & behind, "late").otherwise("on time")
        told = rows.join(known, source, "left").withColumn("arrival", state).drop("_latest", "_fresh")
        told.filter("arrival <> 'held'").write.mode("overwrite").parquet(f"{at}/told/epoch={epoch}")
        told.filter("arrival = 'held'").drop("arrival").select(*events.columns).write.mode("overwrite").parquet(f"{at}/held/{epoch}")
        new = spark.read.parquet(f"{at}/told/epoch={epoch}").filter(F.col(moment).isNotNull() & F.col(source).isNotNull()).select(source, F.col(moment).alias("_latest"))
        known.unionByName(new).groupBy(source).agg(F.max("_latest").alias("_latest")).write.mode("overwrite").parquet(f"{at}/latest/{epoch}")
        newest[0] = epoch

    newest = [-1]
    q = events.writeStream.foreachBatch(sort).option("checkpointLocation", progress or shared_place(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*events.schema.fields, T.StructField("arrival", T.StringType())])
    if newest[0] < 0:
        return spark.createDataFrame([], schema)
    told = spark.read.schema(schema).option("basePath", f"{at}/told").parquet(f"{at}/told/epoch=*").select(*schema.names)
    return told.unionByName(spark.read.schema(events.schema).parquet(f"{at}/held/{newest[0]}").withColumn("arrival", F.lit("held")))
