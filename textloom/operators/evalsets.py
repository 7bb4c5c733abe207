"""Evaluation inputs: encoded pairs, sentence sets, probing spans, masked minimal pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import arrays as ar
from textloom.functions import text as tx
from textloom.functions.words import CLS, MASK, PAD, SEP

# Probing tasks whose examples have two spans.
TWO_SPANS = ("coref", "srl", "ud")


def fill_labels(label: Column) -> Column:
    """Missing test labels become -1."""
    return F.coalesce(label.cast("int"), F.lit(-1))


def encode_pair(a: Column, b: Column, max_length: int, pad_id: int = 0) -> tuple[Column, Column]:
    """Both id lists joined, cut from the right or padded; and the mask, 1 on real tokens."""
    ids = ar.head(F.concat(a, b), max_length)
    return ar.pad(ids, max_length, pad_id), ar.pad(ar.repeat(1, F.size(ids)), max_length, 0)


def encode_framed_pair(a: Column, b: Column, max_length: int, cls: int = CLS, sep: int = SEP, pad_id: int = PAD) -> tuple[Column, Column]:
    """[CLS] a [SEP] b [SEP], padded; over-long pairs lose their longer side first."""
    end = F.array(F.lit(sep))

    def framed(both):
        cut = ar.cut_to(both, ar.fair_lengths(F.transform(both, F.size), F.lit(max_length - 3)))
        return ar.let(cut, lambda c: F.concat(F.array(F.lit(cls)), c[0], end, c[1], end))

    ids = ar.let(F.array(a, b), framed)
    padded = ar.let(ids, lambda x: ar.pad(x, max_length, pad_id))
    return padded, ar.let(F.size(ids), lambda n: ar.pad(ar.repeat(1, n), max_length, 0))


def longest_pair(rows: DataFrame, a: str, b: str, specials: int = 0) -> DataFrame:
    return rows.agg(F.max(F.size(F.concat(a, b)) + specials).alias("max_length"))


def label_balance(rows: DataFrame, label: str = "label") -> DataFrame:
    positive = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint")
    n = F.count(F.lit(1))
    return rows.agg(positive.alias("positives"), n.alias("n"), (positive * 100.0 / n).alias("percent"))


def attach_predictions(rows: DataFrame, scores: DataFrame, key: str = "row_id") -> DataFrame:
    """Test rows with the index of their highest score."""
    best = scores.select(key, ar.argmax(F.col("logits")).alias("predicted"))
    return rows.join(best, key, "left")


# --- sentence sets -----------------------------------------------------------------------


def truncate_sentences(sentences: Column, max_length: int) -> Column:
    """Shorten the longest sentences until all fit with their separators."""
    budget = F.lit(max_length - 1) - F.size(sentences)
    lengths = F.transform(sentences, lambda s: F.size(s))
    return ar.cut_to(sentences, ar.fair_lengths(lengths, budget))


def framed_length(sentences: Column) -> Column:
    return F.aggregate(sentences, F.lit(1), lambda acc, s: acc + F.size(s) + 1)


def cut_first_sentence(sentences: Column, max_length: int) -> Column:
    """Take what is still too long from the first sentence only."""
    over = framed_length(sentences) - max_length
    kept = F.transform(sentences, lambda s, i: F.when((i == 0) & (over > 0), ar.head(s, F.size(s) - over)).otherwise(s))
    return kept


def join_sentences(sentences: Column, cls: int = CLS, sep: int = SEP) -> Column:
    return F.concat(
        F.array(F.lit(cls)), F.flatten(F.transform(sentences, lambda s: F.concat(s, F.array(F.lit(sep)))))
    )


def sentence_parity(sentences: Column) -> Column:
    """0 for the start, then i mod 2 over sentence i and its separator."""
    runs = F.transform(sentences, lambda s, i: ar.repeat(i % 2, F.size(s) + 1))
    return F.concat(F.array(F.lit(0)), F.flatten(runs))


def join_span_masks(masks: Column) -> Column:
    """Span masks with True at the start and at every separator."""
    end = F.array(F.lit(True))
    return F.concat(end, F.flatten(F.transform(masks, lambda m: F.concat(m, end))))


def collate_sentences(rows: DataFrame, batch: str = "batch", max_length: int = 512, pad_id: int = PAD) -> DataFrame:
    """Join each example's sentences and pad to the longest example of its batch."""
    rows = rows.withColumn("sentences", cut_first_sentence(F.col("sentences"), max_length))
    rows = rows.withColumn("length", framed_length(F.col("sentences")))
    width = F.max("length").over(Window.partitionBy(batch))
    rows = rows.withColumn("width", width)
    out = {
        "input_ids": ar.pad(join_sentences(F.col("sentences")), F.col("width"), pad_id),
        "segment_ids": ar.pad(sentence_parity(F.col("sentences")), F.col("width"), 0),
        "is_pad": ar.padding_mask(F.col("length"), F.col("width")),
    }
    if "span_masks" in rows.columns:
        out["span_mask"] = ar.pad(join_span_masks(F.col("span_masks")), F.col("width"), True)
    return rows.withColumns(out)


# Which evaluation splits a task reads.
EXTRA_SPLITS = {"mnli": ("validation_matched", "validation_mismatched", "validation_hans")}


def validation_splits(rows: DataFrame, task: str) -> DataFrame:
    return rows.where(F.col("split").isin(*EXTRA_SPLITS.get(task, ("validation",))))


# --- probing spans -----------------------------------------------------------------------


def labelled_spans(sentences: DataFrame, n_classes: dict, low: int = 1, high: int = 126) -> DataFrame:
    """One row per labelled span: multi-hot label and span masks over the sentence.

    A task without an entry in ``n_classes`` keeps its spans, with null labels.
    """
    kept = sentences.where(tx.subword_count_between(F.col("subwords"), low, high))
    spans = kept.select(
        "sent_id", "subwords", F.explode(F.map_entries("tasks")).alias("t")
    ).select("sent_id", "subwords", F.col("t.key").alias("task"), F.posexplode("t.value").alias("span_no", "span"))
    hot = F.lit(None).cast("array<int>")
    for task, n in n_classes.items():
        hot = F.when(F.col("task") == task, ar.multi_hot(F.col("span.label"), n)).otherwise(hot)
    n = F.size("subwords")
    second = ar.span_mask(n, F.col("span.span_2.s"), F.col("span.span_2.e"))
    return spans.select(
        "sent_id", "task", "span_no",
        hot.alias("labels"),
        ar.span_mask(n, F.col("span.span_1.s"), F.col("span.span_1.e")).alias("span_mask_1"),
        F.when(F.col("task").isin(*TWO_SPANS), second).alias("span_mask_2"),
    )


def collate_probes(sentences: DataFrame, spans: DataFrame, batch: str = "batch", pad_id: int = PAD) -> tuple[DataFrame, DataFrame]:
    """Padded sentences with their index in the batch, and spans shifted by one for the start."""
    w = Window.partitionBy(batch)
    placed = sentences.withColumns({
        "width": F.max(F.size("subwords") + 2).over(w),
        "sentence_index": F.row_number().over(w.orderBy("sent_id")) - 1,
    })
    inputs = placed.select(
        "sent_id", batch, "sentence_index", "width",
        ar.pad(ar.frame(F.col("subwords"), CLS, SEP), F.col("width"), pad_id).alias("input_ids"),
        ar.padding_mask(F.size("subwords") + 2, F.col("width")).alias("is_pad"),
    )
    start = F.array(F.lit(True))
    joined = spans.join(placed.select("sent_id", batch, "sentence_index", "width"), "sent_id")
    shifted = {
        m: F.when(F.col(m).isNotNull(), ar.pad(F.concat(start, F.col(m)), F.col("width"), True))
        for m in ("span_mask_1", "span_mask_2")
    }
    return inputs, joined.withColumns(shifted)


# --- minimal pairs -----------------------------------------------------------------------


def mask_each_position(pairs: DataFrame, keys: list[str], ids: str = "token_ids", width: str = "width",
                       cls: int = CLS, sep: int = SEP, pad: int = PAD, mask: int = MASK) -> DataFrame:
    """One framed and padded copy per token, with that token masked; ``target`` is the token."""
    rows = pairs.select(*keys, ids, width, F.posexplode(ids).alias("pos", "target"))
    framed = ar.pad(ar.frame(F.col(ids), cls, sep), F.col(width) + 2, pad)
    masked = F.transform(framed, lambda x, i: F.when(i == F.col("pos") + 1, F.lit(mask)).otherwise(x))
    return rows.select(*keys, "pos", "target", masked.alias("input_ids"),
                       ar.padding_mask(F.size(ids) + 2, F.col(width) + 2).alias("is_pad"))


def with_pair_width(pairs: DataFrame, keys: list[str], ids: str = "token_ids") -> DataFrame:
    """Length of the longer side of each pair; a pair is two rows."""
    return pairs.withColumn("width", F.max(F.size(ids)).over(Window.partitionBy(*keys)))
