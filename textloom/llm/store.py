"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The rows, written once as Parquet under ``spark.checkpoint.dir`` and read back.

    Cuts the lineage and survives lost executors; what is written by one task attempt is seen by all later readers.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/textloom-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Number of partitions that grows with the rows, and is at least the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so when the driver collects its garbage.

    Twice, because the first round only lets go of the plans that hold the shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
