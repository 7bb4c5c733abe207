"""Vocabularies learned from word counts.

Only ``word_counts`` reads the corpus. The trainers work on the distinct-word table; what
reaches the driver is bounded by the vocabulary size or by one round's candidate list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.words import SPECIALS, whitespace_words
from textloom.operators import merges
from textloom.session import cut_lineage

def training_text(t):
    """Corpus text as the trainers see it: no tab marks, no outer blanks."""
    return tx.drop_tab_marks(t)


def word_counts(df: DataFrame, text: str = "text", words=whitespace_words, drop_tabs: bool = True) -> DataFrame:
    """(word, freq) over all lines; blank lines have no words."""
    t = training_text(F.col(text)) if drop_tabs else tx.strip(F.col(text))
    exploded = df.select(F.explode(words(t)).alias("word"))
    return exploded.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def segment_words(counts: DataFrame, morphs: DataFrame) -> DataFrame:
    """Replace words by their morphs where a (word, morphs) table knows them, before training."""
    parts = F.coalesce("morphs", F.array("word"))
    joined = counts.join(morphs, "word", "left").select(F.explode(parts).alias("word"), "freq")
    return joined.groupBy("word").agg(F.sum("freq").alias("freq"))


def _special_rows(spark):
    rows = [(t, i, 0.0, "special") for i, t in enumerate(SPECIALS)]
    return spark.createDataFrame(rows, "token string, id int, score double, kind string")


def _number(tokens: DataFrame, order: list, start: int, score, kind: str) -> DataFrame:
    """Ids in the given order; ``tokens`` is already cut to the vocabulary size."""
    rank = F.row_number().over(Window.orderBy(*order))
    return tokens.select(
        "token", (rank - 1 + start).cast("int").alias("id"), score.cast("double").alias("score"), F.lit(kind).alias("kind")
    )


def wordlevel_vocab(counts: DataFrame, vocab_size: int = 50227, min_frequency: int = 2) -> DataFrame:
    """The most frequent words, specials first; ties in word order."""
    n = vocab_size - len(SPECIALS)
    top = (
        counts.where(F.col("freq") >= min_frequency)
        .orderBy(F.desc("freq"), "word").limit(n)
        .withColumnRenamed("word", "token")
    )
    rows = _number(top, [F.desc("freq"), F.col("token")], len(SPECIALS), F.col("freq"), "word")
    return _special_rows(counts.sparkSession).unionByName(rows)


def model_rows(df: DataFrame) -> list:
    """Rows of a model: a vocabulary, a merge table or an alphabet, whose size its caller chose when training it."""
    return df.collect()


def tasks_for(rows: int, per_task: int) -> int:
    """Tasks for a table that is small in bytes but costly per row, where AQE would merge too much."""
    return max(1, -(-rows // per_task))


# --- byte pair merges --------------------------------------------------------------------


class _Names:
    """Tokens by symbol; gives merges their symbols, and takes the last new ones back."""

    def __init__(self, tokens: list[str], prefix: str):
        self.tokens, self.prefix = tokens, prefix
        self.ids = {t: i for i, t in enumerate(tokens)}

    def __call__(self, left: int, right: int) -> tuple[int, bool]:
        a, b = self.tokens[left], self.tokens[right]
        made = a + (b[len(self.prefix) :] if self.prefix and b.startswith(self.prefix) else b)
        new = made not in self.ids
        if new:
            self.ids[made] = len(self.tokens)
            self.tokens.append(made)
        return self.ids[made], new

    def undo(self, n: int) -> None:
        for _ in range(n):
            del self.ids[self.tokens.pop()]


def _symbols(ids: dict[str, int], prefix: str):
    """Words as arrays of symbols; the symbols after the first carry the prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = {t[len(prefix) :]: i for t, i in ids.items() if t.startswith(prefix)}
        for b in batches:
            made = [np.array([ids[w[0]], *map(inner.__getitem__, w[1:])], np.int32).tobytes() for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), b.column(1)], names=["w", "freq"])

    return run


def train_bpe(
    counts: DataFrame, vocab_size: int, min_frequency: int = 2, prefix: str = "", words_per_task: int = 100_000, **kw
) -> tuple[DataFrame, DataFrame]:
    """Byte pair merges over distinct words; returns the (vocab, merges) tables.

    The best pair wins by count, then by symbol ids. ``prefix`` marks symbols that continue a word. See ``merges.learn``.
    """
    spark = counts.sparkSession
    words = counts.where(F.length("word") > 0).select("word", "freq").persist(StorageLevel.MEMORY_AND_DISK)
    chars = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = sorted(r["c"] for r in model_rows(chars))
    tokens = list(SPECIALS) + [c for c in alphabet if c not in SPECIALS]
    letters = {c: i for i, c in enumerate(tokens) if i >= len(SPECIALS) or c in set(alphabet)}
    if prefix:
        rest = F.substr("word", F.lit(2))
        later = words.select(F.explode(F.array_distinct(F.split(rest, ""))).alias("c")).where("c <> ''").distinct()
        for c in sorted(r["c"] for r in model_rows(later)):
            letters[prefix + c] = len(tokens)
            tokens.append(prefix + c)
    long = words.where(F.length("word") > 1).select("word", F.col("freq").cast("long"))
    state = long.repartition(tasks_for(words.count(), words_per_task), "word").mapInArrow(_symbols(letters, prefix), "w binary, freq long")
    state = cut_lineage(state)
    words.unpersist()
    names = _Names(tokens, prefix)
    found = merges.learn(state, vocab_size - len(tokens), min_frequency, names, **kw)
    tokens = names.tokens
    kinds = ["special"] * len(SPECIALS) + ["piece"] * (len(tokens) - len(SPECIALS))
    vocab = spark.createDataFrame(
        [(t, i, 0.0, k) for i, (t, k) in enumerate(zip(tokens, kinds))],
        "token string, id int, score double, kind string",
    )
    table = spark.createDataFrame(
        [(i, tokens[a], tokens[b]) for i, (a, b) in enumerate(found)], "rank int, left string, right string"
    )
    return vocab, table


def train_wordpiece(counts: DataFrame, vocab_size: int = 2**14, min_frequency: int = 10, prefix: str = "", **kw) -> DataFrame:
    """WordPiece vocabulary, learned by the same merges; encoding uses longest match."""
    return train_bpe(counts, vocab_size, min_frequency, prefix, **kw)[0]


# --- frequencies over an encoded vocabulary ----------------------------------------------


def token_frequencies(encoded_words: DataFrame) -> DataFrame:
    """(token, freq) from (tokens array, freq) of distinct words."""
    tokens = encoded_words.select(F.explode("tokens").alias("token"), "freq")
    return tokens.groupBy("token").agg(F.sum("freq").alias("freq"))


def top_tokens(freqs: DataFrame, k: int = 100) -> DataFrame:
    return freqs.orderBy(F.desc("freq"), "token").limit(k)


def frequency_at_95(freqs: DataFrame) -> DataFrame:
    """Frequency of the token at rank 95 % of the vocabulary, counted from the most frequent.

    Tokens with the same frequency are interchangeable, so only the histogram of frequencies
    is ordered.
    """
    hist = freqs.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("freq"))
    seen = hist.select(
        "freq",
        F.sum("n").over(w).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("size"),
    )
    rank = F.floor(F.col("size") * 95 / 100)
    return seen.where(F.col("upto") > rank).agg(F.max("freq").alias("f95"), F.max("size").alias("vocab_size"))
