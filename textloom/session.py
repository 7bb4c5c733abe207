"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "textloom", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config(TABLE_PARTITIONS, str(os.cpu_count() if cpus == "*" else cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the cluster's own setting, a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="textloom-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Session setting: how many partitions ``spread`` deals a table to. Unset: tables stay as they are read.
TABLE_PARTITIONS = "spark.textloom.tablePartitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to as many partitions as the session asks for, whatever the size.

    For local runs over few unsplittable files, which would leave cores idle; a cluster leaves the setting out.
    """
    n = df.sparkSession.conf.get(TABLE_PARTITIONS, "")
    return df.repartition(int(n)) if n else df
