"""Applying a vocabulary: words to ids and back.

Words in rows are looked up by a join with the vocabulary; Spark measures the vocabulary and broadcasts it
only below its size threshold, and beyond that shuffles both sides and splits hot words (AQE).
Words in arrays are looked up in place.
Merging, longest match and best path have no expression form; they run in an Arrow function
that remembers words it has seen, so no text is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from textloom.functions.words import UNK, hide_bytes
from textloom.operators.vocab import model_rows, tasks_for

_REMEMBERED = 1 << 18


def encode_by_lookup(tokens: DataFrame, vocab: DataFrame, keys: list[str], pos: str = "pos", word: str = "word") -> DataFrame:
    """(keys, ids) from one row per word, or from arrays of words; unknown words become the unknown id.

    Arrays are looked up where they are, with the vocabulary shared as the splitters' models are: no word becomes a row.
    Arrays of the same keys are put together by the words' places.
    """
    if isinstance(tokens.schema[word].dataType, ArrayType):
        return _encode_arrays(tokens.select(*keys, F.col(word).alias("ids")), vocab, keys)
    known = vocab.select(F.col("token").alias(word), "id")
    found = tokens.join(known, word, "left").withColumn("id", F.coalesce("id", F.lit(UNK)))
    return found.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(pos, "id"))), lambda s: s["id"]).alias("ids")
    )


def _encode_arrays(rows: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    model = model_rows(vocab.select("token", "id"))
    shared = rows.sparkSession.sparkContext.broadcast(([r["token"] for r in model], [r["id"] for r in model]))
    schema = StructType([*rows.select(*keys).schema.fields, StructField("ids", ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = pa.array(shared.value[0], pa.string()), pa.array(shared.value[1], pa.int32())
        for b in batches:
            b = b.filter(pc.fill_null(pc.greater(pc.list_value_length(b.column("ids")), 0), False))
            lists = b.column("ids")
            found = pc.fill_null(ids.take(pc.index_in(lists.flatten().cast(pa.string()), value_set=known)), UNK)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(lists, found)], names=b.schema.names)

    return _put_together(rows.mapInArrow(run, schema), schema, keys, lambda k: k)


def _lists(like: pa.Array, values: pa.Array) -> pa.Array:
    """Arrays of the same lengths with other values."""
    ends = np.cumsum(pc.list_value_length(like).to_numpy(zero_copy_only=False), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), values)


def _put_together(found: DataFrame, schema: StructType, keys: list[str], order) -> DataFrame:
    """(keys, ids) with one row for the keys: ids by their places, those of one place by ``order``."""

    def joined(lists: list) -> list:
        if len(lists) == 1:
            return lists[0]
        return [x for _, x in sorted((p for ids in lists for p in enumerate(ids)), key=lambda p: (p[0], order(p[1])))]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows, those of the same keys as one; the last one of a batch may go on in the next."""
        out = None
        last, held = None, []
        for b in batches:
            out = b.schema
            lists = b.column("ids")
            of = list(zip(*[c.to_pylist() for c in b.columns[:-1]], strict=True))
            starts = [i for i, k in enumerate(of) if not i or k != of[i - 1]]
            alone, several = [], []
            for s, e in zip(starts, [*starts[1:], len(of)], strict=True):
                if not held or of[s] != last:
                    if held:
                        several.append((*last, joined(held)))
                        held = []
                    if e - s == 1 and e < len(of):
                        alone.append(s)
                        continue
                last = of[s]
                held += lists.slice(s, e - s).to_pylist()
            if alone:
                yield b.take(pa.array(alone))
            if several:
                yield _row_batch(several, out)
        if held:
            yield _row_batch([(*last, joined(held))], out)

    return found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(together, schema)


def _row_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class _MergeModel:
    def __init__(self, tokens: set, merges: list):
        self.tokens = tokens
        self.ranks = {(a, b): (i, a + b) for i, (a, b) in enumerate(merges)}

    def __call__(self, word: str) -> list:
        symbols = [c if c in self.tokens else "[UNK]" for c in word]
        found = list(map(self.ranks.get, zip(symbols, symbols[1:])))  # (rank, merged) of each pair, or None
        while any(found):
            best = min(filter(None, found))
            out, i = [], 0
            while i < len(symbols):
                if i < len(found) and found[i] == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
            found = list(map(self.ranks.get, zip(symbols, symbols[1:])))
        return symbols


class _LongestMatch:
    def __init__(self, tokens: set, prefix: str, longest_word: int | None = None):
        self.tokens, self.prefix, self.longest_word = tokens, prefix, longest_word
        self.span = max(map(len, tokens), default=1)

    def __call__(self, word: str) -> list:
        if self.longest_word is not None and len(word) > self.longest_word:
            return ["[UNK]"]
        out, i = [], 0
        while i < len(word):
            lead = self.prefix if i else ""
            for j in range(min(len(word), i + self.span), i, -1):
                if lead + word[i:j] in self.tokens:
                    out.append(lead + word[i:j])
                    i = j
                    break
            else:
                return ["[UNK]"]
        return out


class _BestPath:
    """Most probable split; an unknown character costs more than any piece."""

    def __init__(self, scores: dict):
        self.scores = scores
        self.span = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0

    def __call__(self, word: str) -> list:
        n = len(word)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.span), j):
                s = self.scores.get(word[i:j], self.unknown if j - i == 1 else None)
                if s is not None and best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, i
        out, j = [], n
        while j > 0:
            piece = word[back[j]:j]
            unknown = piece not in self.scores
            if not (unknown and out and out[-1] == "[UNK]"):
                out.append("[UNK]" if unknown else piece)
            j = back[j]
        return out[::-1]


def _split_words(build, data: tuple, spark):
    """Arrow function array<word> -> array<token>; every task builds its model once and splits a batch's words once each."""
    shared = spark.sparkContext.broadcast(data)

    @F.arrow_udf(ArrayType(StringType()))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, seen, codes = build(*shared.value), {}, {}

        def one(word: str) -> list[int]:
            got = seen.get(word)
            if got is None:
                if len(seen) >= _REMEMBERED:
                    seen.clear()
                got = seen[word] = [codes.setdefault(t, len(codes)) for t in model(word)]
            return got

        for lists in batches:
            words = lists.flatten().dictionary_encode()
            made = [one(w) for w in words.dictionary.to_pylist()]
            size = np.array([len(x) for x in made], np.int64)
            flat = np.fromiter(chain.from_iterable(made), np.int64, size.sum())
            first, place = np.cumsum(size) - size, words.indices.to_numpy()
            n = size[place]
            upto = np.concatenate([[0], np.cumsum(n)])
            found = flat[np.repeat(first[place] - upto[:-1], n) + np.arange(upto[-1])]
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            offsets = pa.array(upto[ends.astype(np.int64)].astype(np.int32), pa.int32(), mask=np.append(pc.is_null(lists).to_numpy(zero_copy_only=False), False))
            yield pa.ListArray.from_arrays(offsets, pa.array(list(codes), pa.string()).take(pa.array(found)))

    return split


def bpe_splitter(vocab: DataFrame, merges: DataFrame):
    tokens = {r["token"] for r in model_rows(vocab.select("token"))}
    pairs = [(r["left"], r["right"]) for r in sorted(model_rows(merges), key=lambda r: r["rank"])]
    return _split_words(_MergeModel, (tokens, pairs), vocab.sparkSession)


def wordpiece_splitter(vocab: DataFrame, prefix: str = "", longest_word: int | None = None):
    """Longest match first. Words over ``longest_word`` characters become unknown where the caller sets it (some tools: 100)."""
    tokens = {r["token"] for r in model_rows(vocab.where("kind <> 'special'").select("token"))}
    return _split_words(_LongestMatch, (tokens, prefix, longest_word), vocab.sparkSession)


def split_counts(counts: DataFrame, splitter, words_per_task: int = 100_000) -> DataFrame:
    """(tokens, freq) from (word, freq); few bytes of words are much work, so they are dealt by their number."""
    dealt = counts.repartition(tasks_for(counts.count(), words_per_task), "word")
    return dealt.select(splitter(F.array("word")).alias("tokens"), "freq")


def unigram_splitter(vocab: DataFrame):
    scores = {r["token"]: r["score"] for r in model_rows(vocab.where("kind <> 'special'").select("token", "score"))}
    return _split_words(_BestPath, (scores,), vocab.sparkSession)


def tokens_to_ids(tokens: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ids) from (keys, tokens array)."""
    return encode_by_lookup(tokens, vocab, keys, word="tokens")


def ids_to_tokens(encoded: DataFrame, vocab: DataFrame, keys: list[str], ids: str = "ids") -> DataFrame:
    """(keys, tokens) from (keys, ids array); ids of the same keys are put together by their places, no id becomes a row."""
    model = model_rows(vocab.select("token", "id"))
    shared = encoded.sparkSession.sparkContext.broadcast(([r["token"] for r in model], [r["id"] for r in model]))
    rows = encoded.select(*keys, F.col(ids).cast(ArrayType(IntegerType())).alias("ids")).where(F.size("ids") > 0)
    fields = rows.select(*keys).schema.fields
    named = {}

    def order(k: int | None) -> str:
        if not named:
            named.update(zip(*reversed(shared.value), strict=True))
        return named.get(k, "[UNK]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = pa.array(shared.value[0], pa.string()), pa.array(shared.value[1], pa.int32())
        for b in batches:
            found = pc.fill_null(tokens.take(pc.index_in(b.column("ids").flatten(), value_set=known)), "[UNK]")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(b.column("ids"), found)], names=[*b.schema.names[:-1], "tokens"])

    whole = _put_together(rows, rows.schema, keys, order)
    return whole.mapInArrow(run, StructType([*fields, StructField("tokens", ArrayType(StringType(), False))]))


def join_tokens(tokens: Column, byte_level: bool = False) -> Column:
    """Text of decoded tokens: byte-level pieces are glued and read back, words are spaced."""
    return hide_bytes(F.array_join(tokens, "")) if byte_level else F.array_join(tokens, " ")


def sample_report(samples: DataFrame, words, splitter, text: str = "text") -> DataFrame:
    """Text next to its space-separated tokens."""
    return samples.withColumn("tokens", F.array_join(splitter(words(F.col(text))), " "))
