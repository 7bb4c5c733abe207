"""Neighbour access, running sums and carried values over ordered lines, without one big window.

A line table has keys (a corpus, a source) and an order inside each key. One key may hold a
third of all rows, so a window over a whole key would be a single task. Instead the integer
order column is cut into ranges (``major >> shift``): a window runs inside each range, the
edge of each range goes into a summary with one row per range, and the summary is treated in
the same way with wider ranges until it is small. Carries come back by an equi-join on the
columns the rows are already partitioned by, so the rows themselves are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineOrder:
    """How lines are ordered.

    keys    columns that restart the order
    major   integer column, ascending inside a key
    minor   further order columns, for several lines with the same ``major``
    shifts  bits dropped from ``major`` at each level; lines that share ``major >> shifts[0]``
            form one window; further levels keep the summary windows at some million
            rows at most, for dense numbers up to 2^44 as for arbitrary 64-bit ones
    """

    keys: tuple[str, ...]
    major: str
    minor: tuple[str, ...] = ()
    shifts: tuple[int, ...] = (14, 28, 46)

    @property
    def columns(self) -> list[str]:
        return [*self.keys, self.major, *self.minor]


DOCUMENT_LINES = LineOrder(("lang", "source"), "doc_id", ("pos",), (12, 26, 44))
FILE_LINES = LineOrder(("split", "corpus"), "line_no", (), (16, 32))


def scan(
    df: DataFrame,
    order: LineOrder,
    *,
    back: Column | None = None,
    depth: int = 1,
    ahead: Column | None = None,
    carry: Column | None = None,
    add: Column | None = None,
) -> DataFrame:
    """Add what each line needs to know about the other lines of its key.

    prev     array of struct(v): ``back`` of the previous lines, nearest first, at most ``depth``
    next     struct(v): ``ahead`` of the next line, null on the last line
    carried  last non-null ``carry`` among earlier lines
    before   sum of ``add`` over earlier lines
    total    sum of ``add`` over the whole key
    """
    feats = {}
    if back is not None:
        feats["tail"] = F.array(F.struct(back.alias("v")))
    if ahead is not None:
        feats["head"] = F.struct(ahead.alias("v"))
    if carry is not None:
        feats["last"] = carry
    if add is not None:
        feats["sum"] = add.cast("bigint")
    return _level(df, order.keys, order.major, order.minor, order.shifts, feats, depth)


def _window_columns(rows: DataFrame, w, feats, depth: int) -> DataFrame:
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    new = {}
    if "tail" in feats:
        none = F.array().cast(rows.schema["_tail"].dataType)
        seen = [F.coalesce(F.lag("_tail", i).over(w), none) for i in range(1, depth + 1)]
        new["prev"] = seen[0] if depth == 1 else F.slice(F.concat(*seen), 1, depth)
    if "head" in feats:
        new["next"] = F.lead("_head").over(w)
    if "last" in feats:
        new["carried"] = F.last("_last", ignorenulls=True).over(earlier)
    if "sum" in feats:
        new["before"] = F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("bigint"))
    return rows.withColumns(new)


def _level(rows, keys, major, minor, shifts, feats, depth) -> DataFrame:
    by = [major, *minor]
    scratch = [f"_{f}" for f in feats]
    if not shifts:
        w = Window.partitionBy(*keys)
        out = _window_columns(rows.withColumns({f"_{f}": c for f, c in feats.items()}), w.orderBy(*by), feats, depth)
        if "sum" in feats:
            out = out.withColumn("total", F.sum("_sum").over(w))
        return out.drop(*scratch)

    # Keys and range travel as one struct. A struct is never null, so the join below adds no
    # filter of its own, and the summary reads the very exchange the rows come from.
    part = f"_part{len(shifts)}"
    bucket = f"_range{len(shifts)}"
    columns = rows.columns
    rest = [c for c in columns if c not in keys]
    at = F.shiftright(F.col(major).cast("bigint"), shifts[0]).alias(bucket)
    rows = rows.select(F.struct(*keys, at).alias(part), *rest).repartition(part)
    rows = rows.withColumns({f"_{f}": c for f, c in feats.items()})
    w = Window.partitionBy(part).orderBy(*by)
    rows = _window_columns(rows, w, feats, depth)
    edges = rows.withColumns({
        "_first": F.lag(F.lit(True)).over(w).isNull(),
        "_end": F.lead(F.lit(True)).over(w).isNull(),
    }).where("_first or _end")

    def edge(flag, value):
        return F.first(F.when(F.col(flag), value), ignorenulls=True)

    aggs, carried = [], []
    if "tail" in feats:
        aggs.append(edge("_end", F.slice(F.concat("_tail", "prev"), 1, depth)).alias("_tail"))
        carried.append("prev")
    if "head" in feats:
        aggs.append(edge("_first", F.col("_head")).alias("_head"))
        carried.append("next")
    if "last" in feats:
        aggs.append(edge("_end", F.coalesce("_last", "carried")).alias("_last"))
        carried.append("carried")
    if "sum" in feats:
        aggs.append(edge("_end", F.col("before") + F.col("_sum")).alias("_sum"))
        carried += ["before", "total"]
    summary = edges.groupBy(part).agg(*aggs).select(part, f"{part}.*", *scratch)
    narrower = tuple(s - shifts[0] for s in shifts[1:])
    above = _level(summary, keys, bucket, (), narrower, {f: F.col(f"_{f}") for f in feats}, depth)
    above = above.select(part, *[F.col(c).alias(f"_up_{c}") for c in carried])

    rows = rows.join(above, part, "left")
    joined = {}
    if "tail" in feats:
        joined["prev"] = F.slice(F.concat("prev", "_up_prev"), 1, depth)
    if "head" in feats:
        joined["next"] = F.coalesce("next", "_up_next")
    if "last" in feats:
        joined["carried"] = F.coalesce("carried", "_up_carried")
    if "sum" in feats:
        joined["before"] = F.col("before") + F.col("_up_before")
        joined["total"] = F.col("_up_total")
    rows = rows.withColumns(joined)
    return rows.select(*[F.col(f"{part}.{c}").alias(c) if c in keys else F.col(c) for c in columns], *carried)


def dense_index(df: DataFrame, order: LineOrder, name: str = "line_no") -> DataFrame:
    """Number the lines of each key 0, 1, 2, … in order."""
    return scan(df, order, add=F.lit(1)).withColumnRenamed("before", name).drop("total")
