"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with factor f = target / source size goes in floor(f) times, and once more with probability
f - floor(f). The extra copies are rounded dependently: two documents with fractional probabilities meet, and word mass moves
at random from one to the other until one of them is 0 or 1. The mean of every probability and the source's sum of words
stay as they are. Documents meet inside hash groups of bounded size; each group leaves at most one fractional document, and
these meet in the groups of the next level of the tree.

In a pair of a large and a small document it is the small one that becomes integral, so the tree leaves a large one open.
Therefore some documents of each size class (powers of two; all in small sources) wait for the end of the tree and meet there
with the open one, class by class from the largest. Each class gets the factor that the words still missing ask for (between
0 and ``most``), is rounded in pairs, and its last open document goes the way that the smaller classes can make up for, at
random if they can for both. So a source misses its target by less than a document of its smallest class, unless no choice
for the large ones leaves an amount that the small ones can fill. The price: the mean of a waiting document's copies is no
longer exactly f, but follows how the larger ones were rounded, and a document too large for the target is left out.
All draws come from the keys, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.store import written

#: Documents of a group of the tree; documents of each size class that wait for its end, in sources beyond one group.
GROUP_ROWS, WAITING = 4_096, 64
_EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]"), lambda w: w != "")
    return F.when(text.isNull(), 0).otherwise(F.size(words)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    Sources by code point, null last, have the weights in turn, repeating. A target stops at ``most`` times the source's
    size; the rest shares what is left by weight. That is target = min(most * size, level * weight) with one level for all,
    found from running sums in the order of most * size / weight. The window runs over one row for each source.
    """
    cap, weight = F.col("source_size") * float(most), F.col("weight")
    own = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    every = Window.partitionBy()
    by_cap = Window.orderBy(cap / weight, F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum(weight).over(every) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    )
    own = own.withColumn("level", level).withColumn("free", F.col("level") * weight < cap)
    flat = F.max(F.when(F.col("free"), F.col("level"))).over(every)  # of the first free one
    target = F.when(flat.isNull(), cap).otherwise(F.least(cap, flat * weight))
    return own.select("source", "source_size", target.cast("double").alias("target"))


def pivotal(size: np.ndarray, chance: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """The chances after pairing in order: all 0 or 1 but for the returned index (-1: none).

    The one still fractional meets the next; the words size * chance of the two together stay as they are.
    """
    p = chance.copy()
    open_at = -1
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        if open_at < 0:
            open_at = i
            continue
        j = open_at
        a, b = size[i] * p[i], size[j] * p[j]
        up = min(size[i] - a, b)  # words that can go from j to i
        down = min(a, size[j] - b)  # and from i to j
        move = up if draws[i] * (up + down) < down else -down
        p[i], p[j] = (a + move) / size[i], (b - move) / size[j]
        fractional = [k for k in (i, j) if _EPS < p[k] < 1 - _EPS]
        for k in (i, j):
            if k not in fractional:
                p[k] = round(p[k])
        open_at = fractional[0] if fractional else -1
    return p, open_at


def _round_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "draw", "row"], ascending=[False, True, True], kind="stable")
    p, left = pivotal(rows["size"].to_numpy(float), rows["chance"].to_numpy(), rows["draw"].to_numpy())
    rows["chance"] = p
    rows["open"] = np.arange(len(rows)) == left
    return rows


def settle(size: np.ndarray, missing: float, most: float, draws: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """Copies of documents, size classes from large to small, that come to ``missing`` words, as described above."""
    copies = np.zeros(len(size), np.int64)
    kind = np.frexp(size)[1]
    ends = np.append(np.flatnonzero(np.diff(kind)) + 1, len(size))
    rest = np.append(np.cumsum(size[::-1])[::-1], 0)  # words from each document on
    start = 0
    for end in ends:
        part = slice(start, end)
        factor = min(max(missing / rest[start], 0.0), most)
        whole = np.floor(factor + _EPS)
        p, left = pivotal(size[part], np.full(end - start, max(factor - whole, 0.0)), draws[part])
        if left >= 0:
            chance, p[left] = p[left], 0
            down = missing - ((whole + p) * size[part]).sum()  # what is then left for the smaller ones
            miss = [max(0.0, -x, x - most * rest[end]) for x in (down, down - size[start + left])]
            p[left] = coins[start + left] < chance if abs(miss[0] - miss[1]) < _EPS else miss[1] < miss[0]
        copies[part] = whole + p
        missing -= (copies[part] * size[part]).sum()
        start = end
    return copies


def _settle_group(most: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind = np.frexp(rows["size"].to_numpy(float))[1]
        rows = rows.iloc[np.lexsort((rows["row"].to_numpy(str), rows["draw"].to_numpy(), -kind))]
        size = rows["size"].to_numpy(float)
        missing = float(((rows["whole"] + rows["chance"]) * size).sum())
        copies = settle(size, missing, most, rows["draw"].to_numpy(), rows["coin"].to_numpy())
        return pd.DataFrame({"row": rows["row"].to_numpy(), "copies": copies})

    return run


def rounded_copies(rows: DataFrame, seed: int, most: float, group_rows: int = GROUP_ROWS, waiting: int = WAITING) -> DataFrame:
    """(row, copies) of a table (row, source, size, whole, chance), by the tree described above.

    ``row`` is a unique string; sizes are positive; whole + chance is at most ``most``. The number of groups of a level follows
    the source's rows. The end of the tree has about ``waiting`` rows of each size class, chosen by hash.
    """
    columns = ("row", "source", "size", "whole", "chance")
    kind = "row string, source string, size long, whole long, chance double, draw double, open boolean"
    unit = lambda level: F.pmod(F.xxhash64("row", F.lit(seed), F.lit(level)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    classed = rows.withColumn("_class", F.length(F.bin("size")))
    classes = classed.groupBy("source", "_class").agg(F.count("*").alias("_n"))
    share = F.when(F.sum("_n").over(Window.partitionBy("source")) <= group_rows, 1.0).otherwise(F.lit(float(waiting)) / F.col("_n"))
    classes = classes.select(F.col("source").alias("_source"), F.col("_class").alias("_kind"), share.alias("_share"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_class") == F.col("_kind"))
    tagged = classed.join(classes, same).withColumn("_waits", unit(-2) < F.col("_share"))
    waits = tagged.where("_waits").select(*columns)
    level, todo, done = 0, tagged.where("not _waits").select(*columns), None
    while True:
        rows_of_largest = todo.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if not rows_of_largest:
            break
        groups = -(-rows_of_largest // group_rows)
        here = todo.withColumn("draw", unit(level))
        here = here.withColumn("_g", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))
        here = written(here.groupBy("source", "_g").applyInPandas(lambda _, g: _round_group(g.drop(columns="_g")), kind))
        part = here.where("not open").select("row", (F.col("whole") + F.col("chance").cast("long")).alias("copies"))
        done = part if done is None else done.unionByName(part)
        todo, level = here.where("open").select(*columns), level + 1
        if groups <= 1:
            waits = waits.unionByName(todo)
            break
    last = waits.withColumn("draw", unit(level)).withColumn("coin", unit(-1))
    last = last.groupBy("source").applyInPandas(_settle_group(most), "row string, copies long")
    return last if done is None else done.unionByName(last)


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 42, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(doc_id, source, size, copy_no, source_size, target, copies, taken): one row for each row of ``docs``.

    ``size`` counts words; ``copies`` of the document go into the mix, ``taken`` = copies * size words. Null texts have size
    0, and what has no words is taken 0 times. Null sources are one source. Repeated rows of a document are rounded each on
    its own and told apart by ``copy_no``. A source without words has target 0. An empty table gives no rows. Other
    columns are ignored.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    again = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    sizes = written(sizes.withColumn("copy_no", F.row_number().over(again)))
    targets = source_targets(sizes, weights, most)
    factor = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    key = F.to_json(F.struct("doc_id", "source", "size", "copy_no"))
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    rows = sizes.alias("s").join(targets.alias("t"), same)
    rows = rows.select("doc_id", "s.source", "size", "copy_no", "source_size", "target", factor.alias("factor"))
    rows = written(rows.withColumn("row", key).withColumn("whole", F.floor(F.col("factor") + 1e-12)))
    chance = F.greatest(F.col("factor") - F.col("whole"), F.lit(0.0))
    split = rows.where("size > 0").select("row", "source", "size", "whole", chance.alias("chance"))
    found = rounded_copies(split, seed, float(most), group_rows)
    return rows.join(found, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0).cast("long"))).select(
        "doc_id", "source", "size", "copy_no", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 42, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows with the same doc_id, source and size share their copies as evenly as whole numbers allow.
    """
    key = lambda size: F.to_json(F.struct("doc_id", "source", size.alias("size")))
    taken = mix(docs, weights, most, seed, group_rows)
    taken = taken.groupBy(key(F.col("size")).alias("_key")).agg(F.sum("copies").alias("_all"), F.count("*").alias("_n"))
    taken = taken.where("_all > 0")
    rows = docs.withColumn("_key", key(word_count(F.col("text")))).join(taken.hint("shuffle_hash"), "_key")
    number = F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    share = F.floor(F.col("_all") / F.col("_n")) + (F.col("_no") <= F.col("_all") % F.col("_n")).cast("long")
    one = rows.where("_n = 1").withColumn("_copies", F.col("_all"))
    more = rows.where("_n > 1").withColumn("_no", number).withColumn("_copies", share).drop("_no")
    again = one.unionByName(more).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return again.select(*docs.columns)
