"""Reproducible randomness: a value depends only on the named parts, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts) -> Column:
    """Hex digest of the parts; sorting by it shuffles."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def uniform_from(hexdigest: Column, slot: int = 0) -> Column:
    """One of four independent numbers in [0, 1) held by a digest."""
    return F.conv(F.substring(hexdigest, 8 * slot + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(*parts) -> Column:
    return uniform_from(digest(*parts))
