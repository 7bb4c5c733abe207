"""Stateless cleaning on a line stream: the same Column steps, no state, no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textloom.functions.repair import apply_steps, clean_steps


def clean_stream(lines: DataFrame, minimal: bool = False, arrow: bool = True) -> DataFrame:
    """Clean the ``text`` of a streaming (or batch) line table; filters that look at neighbours need a batch."""
    return apply_steps(lines, clean_steps(minimal, arrow))
