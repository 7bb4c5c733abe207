"""Labelled tables, nested example sets, vocabularies, metric logs and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR_SCHEMAS = {
    "WaW": "word_a string, word_b string, label int",
    "WaM": "word string, morphology string, label int",
    "WaD": "index bigint, word string, definition string, label int",
}
VOCAB_SCHEMA = "token string, id int, score double, kind string"
MERGES_SCHEMA = "rank int, left string, right string"
METRIC_SCHEMA = "run_id string, step bigint, epoch int, metric string, value double, ts timestamp"
EXAMPLE_SCHEMA = (
    "id bigint, sentences array<array<int>>, span_masks array<array<boolean>>, "
    "label double, entity string, split string"
)
PROBE_SCHEMA = (
    "sent_id bigint, subwords array<int>, tasks map<string, array<struct<label: array<int>, "
    "span_1: struct<s: int, e: int>, span_2: struct<s: int, e: int>>>>"
)
MINIMAL_PAIR_SCHEMA = "grp string, subgrp string, pair_id bigint, side string, token_ids array<int>"

# Selection mode -> (train, dev, test) as (subset, role); the last but one mode
# validates on the other subset's training rows.
SELECTIONS = {
    "IOV": (("IOV", "train"), ("IOV", "dev"), ("IOV", "test")),
    "OOV": (("OOV", "train"), ("OOV", "dev"), ("OOV", "test")),
    "all": (("all", "train"), ("all", "dev"), ("all", "test")),
    "IOV_train_OOV_train_IOV_test": (("IOV", "train"), ("OOV", "train"), ("IOV", "test")),
    "none": (("none", "train"), ("none", "dev"), ("none", "test")),
}


def read_pairs(spark: SparkSession, path: str, task: str, keep_nulls: bool = False) -> DataFrame:
    """Labelled TSV with a header line; rows with any null go unless they are test rows."""
    schema = T.StructType.fromDDL(PAIR_SCHEMAS[task])
    # Labels of a column with gaps may be written as decimals.
    loose = ", ".join(
        f"`{f.name}` {'double' if f.name == 'label' else f.dataType.simpleString()}" for f in schema
    )
    rows = spark.read.schema(loose).option("sep", "\t").option("header", True).option(
        "enforceSchema", True
    ).option("nullValue", "").csv(path)
    rows = rows.withColumn("label", F.col("label").cast("int"))
    return rows if keep_nulls else rows.dropna(how="any")


def select_roles(rows: DataFrame, mode: str) -> DataFrame:
    """Choose train, dev and test rows of a (subset, role) table; ``part`` tells which is which."""
    parts = zip(("train", "dev", "test"), SELECTIONS[mode])
    part = F.lit(None).cast("string")
    keep = F.lit(False)
    for name, (subset, role) in parts:
        here = (F.col("subset") == subset) & (F.col("role") == role)
        part = F.when(here, name).otherwise(part)
        keep = keep | here
    return rows.where(keep).withColumn("part", part)


def write_pairs(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_examples(spark: SparkSession, path: str, schema: str = EXAMPLE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCAB_SCHEMA).parquet(path)


def export_vocab_json(vocab: DataFrame, path: str) -> None:
    """Token and id as JSON lines; the table is bounded by the vocabulary size."""
    vocab.select("token", "id").orderBy("id").coalesce(1).write.mode("overwrite").json(path)


def write_frequencies(freqs: DataFrame, path: str) -> None:
    """``token: freq`` lines, most frequent first."""
    n = int(freqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = freqs.repartitionByRange(n, F.desc("freq"), "token").sortWithinPartitions(F.desc("freq"), "token")
    ordered.select(F.concat_ws(": ", "token", "freq")).write.mode("overwrite").text(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append (run_id, step, epoch, metric, value, ts) rows to a metric log."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(METRIC_SCHEMA)]
    rows.select(*cols).write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).parquet(path)


def read_run_summary(spark: SparkSession, path: str) -> DataFrame:
    """Run results from a CSV of quoted values."""
    raw = spark.read.option("header", True).csv(path)
    numeric = {
        "val_accuracy": "double", "batch_size": "int", "learning_rate": "double", "max_seq_len": "int",
        "num_epochs": "int", "train_loss": "double", "train_time": "double", "val_loss": "double",
    }
    return raw.withColumns({c: F.col(c).cast(t) for c, t in numeric.items() if c in raw.columns})


def read_model_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
