"""Filters and rewrites that look at neighbouring lines.

Each takes a line table with a cleaned ``text`` column (``''`` is a blank line) and a
``LineOrder``; the order columns pass through, so the result can be sorted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators.ordered import LineOrder, scan

_SCRATCH = ("prev", "next", "carried", "before", "total")


def _before(i: int):
    """``text`` of the i-th line before, null where there is none."""
    return F.try_element_at("prev", F.lit(i))["v"]


def drop_repeats(df: DataFrame, order: LineOrder) -> DataFrame:
    """Drop a line equal to the one before; runs of blanks shrink to one."""
    seen = scan(df, order, back=F.col("text"))
    return seen.where(~_before(1).eqNullSafe(F.col("text"))).drop(*_SCRATCH)


def drop_repeats_keep_blanks(df: DataFrame, order: LineOrder) -> DataFrame:
    """Drop a line equal to the one before; every blank stays and ends a run."""
    seen = scan(df, order, back=F.col("text"))
    return seen.where((F.col("text") == "") | ~_before(1).eqNullSafe(F.col("text"))).drop(*_SCRATCH)


def drop_repeats_across_blanks(df: DataFrame, order: LineOrder) -> DataFrame:
    """Drop a line equal to the last non-blank line before it; every blank stays."""
    seen = scan(df, order, carry=F.when(F.col("text") != "", F.col("text")))
    return seen.where((F.col("text") == "") | ~F.col("carried").eqNullSafe(F.col("text"))).drop(*_SCRATCH)


def keep_paragraph_gaps(df: DataFrame, order: LineOrder) -> DataFrame:
    """Keep a blank only after at least two text lines."""
    seen = scan(df, order, back=F.col("text"), depth=2)
    gap = (_before(1) != "") & (_before(2) != "")
    return seen.where((F.col("text") != "") | F.coalesce(gap, F.lit(False))).drop(*_SCRATCH)


def reflow_paragraphs(df: DataFrame, order: LineOrder, flush_tail: bool = False) -> DataFrame:
    """Join each run of text lines into one; keep one blank after a multi-line paragraph.

    A paragraph stands at the blank that ends it; the blank comes out only where a second one
    follows. Lines after the last blank of a key are lost unless ``flush_tail``.
    """
    pos = [order.major, *order.minor]
    blank = F.col("text") == ""
    seen = scan(df, order, back=F.col("text"), depth=3, add=blank.cast("int"))
    gap = blank & (_before(1) == "") & (_before(2) != "") & (_before(3) != "")
    seen = seen.withColumn("gap", F.coalesce(gap, F.lit(False)))
    if not flush_tail:
        seen = seen.where(F.col("before") < F.col("total"))
    idle = blank & ~F.col("gap") & F.coalesce(_before(1) == "", F.lit(True))
    at = F.struct(*pos)
    return (
        seen.where(~idle)
        .groupBy(*order.keys, "before")
        .agg(
            F.array_sort(F.collect_list(F.when(~blank, F.struct(*pos, "text")))).alias("lines"),
            F.coalesce(F.max(F.when(blank, at)), F.max(at)).alias("at"),
            F.max("gap").alias("gap"),
        )
        .where((F.size("lines") > 0) | F.col("gap"))
        .select(
            *order.keys,
            *[F.col(f"at.{c}").alias(c) for c in pos],
            F.array_join(F.transform("lines", lambda s: s["text"]), " ").alias("text"),
        )
    )


def drop_stub_entries(df: DataFrame, order: LineOrder, stub: str = "is_stub", flush_tail: bool = False) -> DataFrame:
    """Drop stub lines together with the line before each (its title).

    A blank stays only right after a surviving text line; the very last line of a key has no
    follower and is lost unless ``flush_tail``.
    """
    state = F.struct("text", F.coalesce(F.col(stub), F.lit(False)).alias("stub"))
    seen = scan(df, order, back=state, ahead=state)
    prev, nxt = F.try_element_at("prev", F.lit(1))["v"], F.col("next")["v"]
    text_stays = ~F.coalesce(F.col(stub), F.lit(False)) & F.coalesce(~nxt["stub"], F.lit(flush_tail))
    blank_stays = F.coalesce((prev["text"] != "") & ~prev["stub"], F.lit(False))
    return seen.where(F.when(F.col("text") == "", blank_stays).otherwise(text_stays)).drop(*_SCRATCH)


def blank_before_headings(df: DataFrame, first_line: str = "is_first", sub: str = "sub") -> DataFrame:
    """Put a blank line before every heading that is not the first input line."""
    heading = F.col("text").startswith("= = = ") & ~F.col(first_line)
    both = F.when(heading, F.array(F.lit(""), F.col("text"))).otherwise(F.array(F.col("text")))
    kept = [c for c in df.columns if c not in ("text", first_line)]
    return df.select(*kept, F.posexplode(both).alias(sub, "text"))


def markup_lines(df: DataFrame, first_line: str = "is_first", sub: str = "sub") -> DataFrame:
    """Headings, page furniture, citations, links and heading marks of wiki lines.

    The blank before a heading is emitted before blank input lines are dropped.
    """
    t = F.col("text")
    kept = df.where(tx.not_blank(t) & tx.not_page_furniture(t))
    out = blank_before_headings(kept, first_line, sub)
    t = tx.unwrap_headings(tx.link_targets(tx.drop_citations(F.col("text"))))
    return out.withColumn("text", t)
