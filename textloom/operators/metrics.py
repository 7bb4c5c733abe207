"""Evaluation metrics as aggregations; ``keys`` group the result, empty means one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import arrays as ar
from textloom.operators.ordered import LineOrder, scan


def _mean(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("double")


def masked_token_scores(positions: DataFrame, keys: list[str] = (), ignored: int = -100) -> DataFrame:
    """Loss, accuracy and perplexity over (logits, target) rows, weighted by token."""
    kept = positions.where(F.col("target") != ignored).select(
        *keys,
        ar.cross_entropy(F.col("logits"), F.col("target")).alias("loss"),
        (ar.argmax(F.col("logits")) == F.col("target")).alias("hit"),
    )
    return kept.groupBy(*keys).agg(
        F.avg("loss").alias("loss"), _mean(F.col("hit")).alias("accuracy"),
        F.exp(F.avg("loss")).alias("perplexity"), F.count(F.lit(1)).alias("n"),
    )


def accuracy(rows: DataFrame, keys: list[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    return rows.groupBy(*keys).agg(_mean(F.col(pred) == F.col(label)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def batch_accuracy(rows: DataFrame, batch: str = "batch", pred: str = "pred", label: str = "label") -> DataFrame:
    """Mean of per-batch accuracies next to the plain one; negative labels do not count."""
    valid = F.col(label) >= 0
    hits = F.sum((valid & (F.col(pred) == F.col(label))).cast("bigint"))
    per = rows.groupBy(batch).agg(hits.alias("hits"), F.sum(valid.cast("bigint")).alias("n"))
    one = F.greatest(F.col("n"), F.lit(1))
    return per.agg(
        F.avg(F.col("hits") / one).alias("batch_mean"),
        (F.sum("hits") / F.greatest(F.sum("n"), F.lit(1))).alias("micro"),
        F.count(F.lit(1)).alias("batches"),
    )


def confusion(rows: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    return rows.where(F.col(label) >= 0).groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def _binary_cells(rows, keys, pred, label):
    p, y = F.col(pred) == 1, F.col(label) == 1
    return rows.groupBy(*keys).agg(
        _count_if(p & y).alias("tp"), _count_if(p & ~y).alias("fp"),
        _count_if(~p & y).alias("fn"), _count_if(~p & ~y).alias("tn"),
    )


def matthews(rows: DataFrame, keys: list[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    c = _binary_cells(rows, keys, pred, label)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    under = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return c.select(*keys, F.when(under > 0, (tp * tn - fp * fn) / under).otherwise(0.0).alias("mcc"))


def f1_binary(rows: DataFrame, keys: list[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    c = _binary_cells(rows, keys, pred, label)
    under = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return c.select(*keys, F.when(under > 0, 2 * F.col("tp") / under).otherwise(0.0).alias("f1"))


def f1_macro(rows: DataFrame, n_classes: int, pred: str = "pred", label: str = "label") -> DataFrame:
    """Unweighted mean of per-class F1, in one pass over the rows."""
    scores = []
    for c in range(n_classes):
        p, y = F.col(pred) == c, F.col(label) == c
        under = 2 * _count_if(p & y) + _count_if(p & ~y) + _count_if(~p & y)
        scores.append(F.when(under > 0, 2 * _count_if(p & y) / under).otherwise(0.0))
    return rows.agg((sum(scores[1:], scores[0]) / n_classes).alias("f1_macro"))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"))


def _average_ranks(values: DataFrame, v: str, scale: float, shifts) -> DataFrame:
    """Average rank of each distinct value of (v, n), from a ranged running count."""
    keyed = values.select(
        F.lit(0).alias("_all"), F.col(v), F.col("n"), F.floor(F.col(v) * scale).cast("bigint").alias("_major")
    )
    out = scan(keyed, LineOrder(("_all",), "_major", (v,), shifts), add=F.col("n"))
    return out.select(v, (F.col("before") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2).alias(f"rank_{v}"))


def spearman(rows: DataFrame, x: str, y: str, scale: float = 1.0, shifts=(10, 24, 40)) -> DataFrame:
    """Correlation of average ranks.

    Equal (x, y) rows are counted first, so ties, however many, travel as one row; ``scale``
    spreads fractional values over the integers that cut them into ranges.
    """
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    rx = _average_ranks(pairs.groupBy(x).agg(F.sum("n").alias("n")), x, scale, shifts)
    ry = _average_ranks(pairs.groupBy(y).agg(F.sum("n").alias("n")), y, scale, shifts)
    joined = pairs.join(rx, x).join(ry, y)
    a, b, n = F.col(f"rank_{x}"), F.col(f"rank_{y}"), F.col("n")
    return joined.agg(
        (F.sum(n * a * b) / F.sqrt(F.sum(n * a * a)) / F.sqrt(F.sum(n * b * b))).alias("spearman")
    )


def pairwise_choice(rows: DataFrame, key: str, at: str, pred: str = "pred", label: str = "label") -> DataFrame:
    """Per key, compare the first row with each later one: do score and label agree on the order?"""
    first = rows.groupBy(key).agg(F.min(F.struct(at, pred, label)).alias("f"))
    later = rows.join(first, key).where(F.col(at) > F.col(f"f.{at}"))
    same = (F.col(f"f.{pred}") > F.col(pred)) == (F.col(f"f.{label}") > F.col(label))
    return later.agg(_mean(same).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def minimal_pair_accuracy(scores: DataFrame) -> DataFrame:
    """Percent of pairs whose good side has the higher summed log probability.

    Rows are (grp, subgrp, pair_id, side, log_p). Levels: each subgroup, each group as the mean
    of its subgroups, and the mean over all subgroups.
    """
    good = F.sum(F.when(F.col("side") == "good", F.col("log_p")))
    bad = F.sum(F.when(F.col("side") == "bad", F.col("log_p")))
    pairs = scores.groupBy("grp", "subgrp", "pair_id").agg((good > bad).alias("right"))
    sub = pairs.groupBy("grp", "subgrp").agg((_mean(F.col("right")) * 100.0).alias("accuracy"))
    return sub.groupingSets([["grp", "subgrp"], ["grp"], []], "grp", "subgrp").agg(F.avg("accuracy").alias("accuracy"))


def late_history(log: DataFrame, keys: list[str], step: str, value: str = "value") -> DataFrame:
    """Max, min, mean and sample deviation over the later half of a history, rounded up.

    One row per (keys, step) is expected, as a metric log has.
    """
    w = Window.partitionBy(*keys)
    placed = log.withColumns({"_age": F.row_number().over(w.orderBy(F.desc(step))), "_n": F.count(F.lit(1)).over(w)})
    late = placed.where(F.col("_age") <= F.ceil(F.col("_n") / 2))
    v = F.col(value)
    return late.groupBy(*keys).agg(
        F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.count(F.lit(1)).alias("n"),
    )


def epoch_table(log: DataFrame, metrics: list[str], keys: list[str] = ("run_id", "epoch")) -> DataFrame:
    """One row per epoch with a column per metric."""
    return log.groupBy(*keys).pivot("metric", list(metrics)).agg(F.max("value"))


def probing_f1(spans: DataFrame, keys: list[str] = ("task", "split")) -> DataFrame:
    """Micro F1 of multi-hot predictions, summed over all labels of all spans."""
    def cells(f):
        return F.aggregate(F.zip_with("predicted", "labels", f), F.lit(0), lambda acc, x: acc + x)

    def one(cond):
        return F.when(cond, 1).otherwise(0)

    per = spans.select(
        *keys,
        cells(lambda p, y: one((p > 0) & (y > 0))).alias("tp"),
        cells(lambda p, y: one((p > 0) & (y == 0))).alias("fp"),
        cells(lambda p, y: one((p == 0) & (y > 0))).alias("fn"),
    )
    under = 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")
    return per.groupBy(*keys).agg(F.when(under > 0, 2 * F.sum("tp") / under).otherwise(0.0).alias("f1"))


def top_tokens_per_position(scored: DataFrame, vocab: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """The k most probable tokens of each masked position, as (keys, rank, token, probability)."""
    best = scored.select(*keys, F.posexplode(ar.top_k(ar.softmax(F.col("logits")), k)).alias("rank", "b"))
    named = best.select(*keys, "rank", F.col("b.index").alias("id"), F.col("b.score").alias("probability"))
    return named.join(vocab.select("id", "token"), "id", "left").select(*keys, "rank", "token", "probability")


def vector_statistics(vectors: DataFrame, name: str, values: str) -> DataFrame:
    v = F.col(values).cast("array<double>")
    return vectors.select(name, ar.norm(v).alias("norm"), ar.sample_std(v).alias("std"))


RUN_NAME = r"^(Wa[WMD])_([a-z]+)_([a-z]+)_((?:M-)?[A-Z]+)_(\d+)(?:_(.+))?$"


def leaderboard(runs: DataFrame) -> DataFrame:
    """Best run per (task, language, tokenizer), read from run names."""
    parts = {n: F.regexp_extract("Name", RUN_NAME, i) for i, n in enumerate(("task", "lang", "size", "tokenizer", "vocab"), 1)}
    named = runs.withColumns(parts)
    best = named.groupBy("task", "lang", "tokenizer").agg(
        F.max_by(F.struct("Name", "Notes", "val_accuracy", "val_loss"), "val_accuracy").alias("b"), F.count(F.lit(1)).alias("runs")
    )
    return best.select("task", "lang", "tokenizer", "runs", "b.*")


def elapsed(seconds: Column) -> Column:
    """Rounded seconds as h:mm:ss, with days in front where needed."""
    s = F.bround(seconds).cast("bigint")
    days, rest = F.floor(s / 86400), F.pmod(s, F.lit(86400))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    clock = F.concat_ws(":", F.floor(rest / 3600).cast("string"), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), two(F.pmod(rest, F.lit(60))))
    label = F.when(days == 1, F.lit("1 day, ")).when(days > 1, F.concat(days.cast("string"), F.lit(" days, "))).otherwise(F.lit(""))
    return F.concat(label, clock)
