"""Corpus files as ordered lines, and ordered lines as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.ordered import LineOrder, dense_index

# .../<anything>_<split>/<corpus>.<train|dev|test>, with or without .gz; a file, or a folder of part files
CORPUS_PATH = r"_([^/_]+)/([^/]+)\.(?:train|dev|test)(?:\.gz)?(?:/[^/]+)?$"
_FILE_BITS = 40  # of a place in a file, in bytes or, where the file is compressed, in lines
_FILE_ORDER = LineOrder(("split", "corpus"), "place", (), (22, 36, 50))


def _numbered(raw: DataFrame) -> DataFrame:
    """Adds ``place`` to lines with (path, block, row): ascending by path, and inside a file by line.

    A line's place is the start of its input split plus its number there, which stays below the next split's start. The two
    small tables have one row for each input split and each file.
    """
    splits = raw.groupBy("path", "block").agg(F.min("row").alias("first"))
    files = splits.select("path").distinct()
    files = files.withColumn("file", F.row_number().over(Window.orderBy("path")).cast("bigint"))
    starts = splits.join(files, "path")
    place = F.shiftleft("file", _FILE_BITS) + F.col("block") + F.col("row") - F.col("first")
    return raw.join(starts, ["path", "block"]).withColumn("place", place)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("text"),
    )


def read_corpora(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(split, corpus, line_no, text) of corpus files; line_no counts from 0 in the order of paths and lines.

    Several files of one split and corpus, such as the part files of ``write_lines``, follow one another by path. Files may
    be compressed. A path that names no split and corpus is an error.
    """
    named = F.when(F.col("path").rlike(CORPUS_PATH), F.col("path")).otherwise(
        F.raise_error(F.concat(F.lit("not a corpus path: "), "path"))
    )
    raw = _numbered(_lines(spark, paths)).select(
        F.regexp_extract(named, CORPUS_PATH, 1).alias("split"), F.regexp_extract(named, CORPUS_PATH, 2).alias("corpus"),
        "place", "text",
    )
    return dense_index(raw, _FILE_ORDER).select("split", "corpus", "line_no", "text")


def corpus_paths(root: str, split: str, corpora, prefix: str = "corpus") -> list[str]:
    """Input paths of a split; dev and test files carry the split as suffix, others 'train'."""
    suffix = split if split in ("dev", "test") else "train"
    return [f"{root}/{prefix}_{split}/{c}.{suffix}" for c in corpora]


def write_lines(lines: DataFrame, order: list[str], path: str, files: int | None = None) -> None:
    """Write ``text`` one line per row; file names sort in line order."""
    n = files or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        lines.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("text")
        .write.mode("overwrite")
        .text(path)
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Pre-training segments, one per line, plain or gzipped; spread out after an unsplittable read."""
    raw = _numbered(_lines(spark, path)).select(F.lit("segments").alias("split"), F.col("path").alias("corpus"), "place", "text")
    return dense_index(raw, _FILE_ORDER, "seg_no").select(F.col("corpus").alias("file"), "seg_no", "text")
