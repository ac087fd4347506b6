"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, else under the warehouse, which `clear` removes; on a cluster not under a warehouse that is a local folder, which would be another on each machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        if not spark.sparkContext.master.startswith("local") and place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _made.append(f"{at.rstrip('/')}/tallyfold/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Removes what has been written so far. Results that are still to be computed from it are lost, so it is for the end of a job."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back: computed once, and safe from lost executors."""
    path = shared_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
