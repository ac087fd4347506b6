"""Structured Streaming: windowed counts with a watermark, de-duplicated ingest, the latest reading of each subject, first sightings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lineage import shared_place
from ..operators.store import upsert


def windowed_counts(events: DataFrame, moment: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts of windows; rows later than the watermark are left out."""
    w = F.window(moment, size, slide) if slide else F.window(moment, size)
    return events.withWatermark(moment, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a stream has now, run to its end; the last state of each row it emits is written once and read back."""
    spark = stream.sparkSession
    out = shared_place(spark, "drained")

    def keep(batch: DataFrame, epoch: int) -> None:
        # A batch that is replayed after a failure replaces what it wrote before.
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", shared_place(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out if mode == "complete" else f"{out}/epoch=*")


def ingested_once(events: DataFrame, key: str, moment: str, late: str = "240 days") -> DataFrame:
    """Point events without those whose fingerprint came before within the watermark."""
    return events.withWatermark(moment, late).dropDuplicatesWithinWatermark([key])


def upsert_stream(events: DataFrame, store: str, key: str = "fingerprint") -> None:
    """Batches of a stream merged into a stored table: `store` holds versions, the newest is whole."""
    spark = events.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        path = f"{store}/v{epoch:08d}"
        before = f"{store}/v{epoch - 1:08d}"
        old = spark.read.parquet(before) if epoch else batch.limit(0)
        upsert(old, batch, key).write.mode("overwrite").parquet(path)

    q = events.writeStream.foreachBatch(merge).option("checkpointLocation", shared_place(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()


def _removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _versions(spark: SparkSession, store: str, epoch: int | None = None) -> dict[int, int]:
    """Of each bucket of a store the batch that wrote it last, as of a batch (the newest, unless told): a row a bucket."""
    try:
        known = spark.read.schema("bucket int, version long, epoch long").parquet(f"{store}/versions")
    except AnalysisException:  # nothing written yet
        return {}
    at = known.agg(F.max("epoch")).first()[0] if epoch is None else epoch
    return {r["bucket"]: r["version"] for r in known.filter(F.col("epoch") == F.lit(at)).collect()}


def _place(store: str, bucket: int, version: int) -> str:
    return f"{store}/data/v{version:08d}/_bucket={bucket}"


def upsert_buckets(events: DataFrame, store: str, key: str = "fingerprint", buckets: int = 64, progress: str | None = None) -> None:
    """Batches of a stream merged into a store that is cut into buckets by a hash of the key: a batch reads and rewrites only the buckets that it has rows for. `stored` reads the whole.

    Which batch wrote a bucket last is kept with each batch's number, and what a batch reads stays until the batch after it is done, so a batch that is replayed writes the same again."""
    spark = events.sparkSession
    schema = events.schema

    def merge(batch: DataFrame, epoch: int) -> None:
        before = _versions(spark, store, epoch - 1) if epoch else {}
        dealt = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = sorted(r["_bucket"] for r in dealt.select("_bucket").distinct().collect())  # `buckets` rows at most
        paths = [_place(store, b, before[b]) for b in touched if b in before]
        old = spark.read.schema(schema).parquet(*paths) if paths else batch.limit(0)
        new = upsert(old, batch, key).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        new.write.mode("overwrite").partitionBy("_bucket").parquet(f"{store}/data/v{epoch:08d}")
        now = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{store}/versions/epoch={epoch}")
        if epoch > 1:
            for b, v in _versions(spark, store, epoch - 2).items():
                if before.get(b) != v:
                    _removed(spark, _place(store, b, v))
            _removed(spark, f"{store}/versions/epoch={epoch - 2}")

    q = events.writeStream.foreachBatch(merge).option("checkpointLocation", progress or shared_place(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()


def stored(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """All rows of a store of buckets."""
    paths = [_place(store, b, v) for b, v in _versions(spark, store).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest_reading(events: DataFrame, keys: list[str], moment: str, columns: list[str]) -> DataFrame:
    """The latest reading of each subject as running state: a max over a struct, so state is one row a subject."""
    return events.groupBy(*keys).agg(F.max(F.struct(moment, *columns)).alias("r")).select(*keys, "r.*")


def first_seen(events: DataFrame, key: str, moment: str) -> DataFrame:
    """The first moment of each key ever."""
    return events.groupBy(key).agg(F.min(moment).alias("first_seen"))
