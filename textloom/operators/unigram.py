"""Unigram pieces: substrings seeded by count, fitted by expectation maximisation, pruned by loss.

Distinct words are looked up once: their lattices of seed pieces stay in blocks of some thousand words, whose places are
walked side by side. Spark runs every pass over the blocks: a task emits one partial sum per piece; sums and losses are
aggregations on tables the size of the piece list. The piece list itself is bounded by ``seed_size``, numbered in order,
and shared with tasks; a pass shares the scores alone.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.words import SPECIALS
from textloom.operators.vocab import tasks_for
from textloom.session import cut_lineage

BLOCK = 4_000  # words of a row of lattices
WORDS_PER_TASK = 20_000


def seed_pieces(words: DataFrame, seed_size: int, max_piece: int = 16) -> DataFrame:
    """Characters and frequent substrings of distinct words, scored by count times length."""
    n = F.length("word")
    starts = F.sequence(F.lit(1), n)
    longest = lambda i: F.least(F.lit(max_piece), n - i + 1)
    subs = F.flatten(F.transform(
        starts, lambda i: F.transform(F.sequence(F.lit(1), longest(i)), lambda k: F.substr("word", i, k))
    ))
    counted = words.where(n > 0).select(F.explode(subs).alias("piece"), "freq").groupBy("piece").agg(F.sum("freq").alias("freq"))
    chars = counted.where(F.length("piece") == 1)
    longer = counted.where((F.length("piece") > 1) & (F.col("freq") >= 2)).withColumn("freq", F.col("freq") * F.length("piece"))
    return chars.unionByName(longer.orderBy(F.desc("freq"), "piece").limit(seed_size))


@dataclass(frozen=True)
class Lattices:
    """Edges of words' lattices, by their end's place in the word, then by word, then from the longest on.

    ``sizes`` are the words' lengths, ``degree`` the number of edges into each place, ``span`` and ``piece`` the length and
    number of each edge's piece. Every place has at least one edge into it: its character.
    """

    sizes: np.ndarray
    degree: np.ndarray
    span: np.ndarray
    piece: np.ndarray

    @staticmethod
    def of(words: list[str], index: dict[str, int], longest: int, whole: bool = True) -> Lattices:
        """``whole``: with the edges that are a word as a whole."""
        span, piece, degree, place = [], [], [], []
        for word in words:
            for j in range(1, len(word) + 1):
                before = len(piece)
                for i in range(max(0, j - longest), j):
                    p = index.get(word[i:j])
                    if p is not None and (whole or j - i < len(word)):
                        span.append(j - i)
                        piece.append(p)
                degree.append(len(piece) - before)
                place.append(j)
        degree, place = np.array(degree, np.int64), np.array(place, np.int64)
        by = np.argsort(np.repeat(place, degree), kind="stable")
        return Lattices(
            np.array([len(w) for w in words], np.int32), degree[np.argsort(place, kind="stable")].astype(np.int32),
            np.array(span, np.int32)[by], np.array(piece, np.int32)[by],
        )

    def without(self, scores: np.ndarray) -> Lattices:
        """Only edges of pieces that have a score, and of characters."""
        kept = np.isfinite(scores[self.piece]) | (self.span == 1)
        degree = np.add.reduceat(kept, np.cumsum(self.degree) - self.degree, dtype=np.int32)
        return Lattices(self.sizes, degree, self.span[kept], self.piece[kept])

    @cached_property
    def _nodes(self):
        """First and last node of each word; ends and starts of edges; first edges of places; bounds of steps in places."""
        sizes = self.sizes.astype(np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        by = np.argsort(place, kind="stable")
        node = (np.repeat(first, sizes) + place)[by]
        end = np.repeat(node, self.degree)
        head = np.append(0, np.cumsum(self.degree, dtype=np.int64))
        steps = np.append(0, np.cumsum(np.bincount(place)[1:]))
        return first, first + sizes, node, end, end - self.span, head, steps

    def _steps(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """For each place from the first on: its nodes, their edges, and the first edge of each node among these."""
        *_, head, steps = self._nodes
        for a, b in zip(steps, steps[1:]):
            yield slice(a, b), slice(head[a], head[b]), head[a:b] - head[a]

    def expected(self, scores: np.ndarray, freq: np.ndarray) -> np.ndarray:
        """Expected use of each edge over all splits of its word, times the word's frequency."""
        first, last, node, end, start, _, _ = self._nodes
        score = scores[self.piece]
        into, share = np.full(len(node) + len(first), -np.inf), np.empty(len(score))
        into[first] = 0.0
        steps = list(self._steps())
        with np.errstate(divide="ignore"):
            for nodes, edges, heads in steps:
                v = into[start[edges]] + score[edges]
                top = np.maximum.reduceat(v, heads)
                top[np.isinf(top)] = 0.0
                degree = self.degree[nodes]
                v = np.exp(v - np.repeat(top, degree))
                total = np.add.reduceat(v, heads)
                into[node[nodes]] = top + np.log(total)
                total[total == 0] = 1.0
                share[edges] = v / np.repeat(total, degree)
        use = np.zeros(len(into))
        use[last] = np.where(np.isfinite(into[last]), freq, 0.0)
        for _, edges, _ in reversed(steps):  # what passes through a node is dealt to the edges into it
            share[edges] *= use[end[edges]]
            use[start[edges]] += share[edges]  # edges of a step start at different nodes
        return share

    def best(self, scores: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """Score of each word's most probable split (-inf: none), and its parts as (words, edges) from the last part on."""
        first, last, node, _, start, _, _ = self._nodes
        score = scores[self.piece]
        best, back = np.full(len(node) + len(first), -np.inf), np.zeros(len(node) + len(first), np.int64)
        best[first] = 0.0
        for nodes, edges, heads in self._steps():
            v = best[start[edges]] + score[edges]
            top = np.maximum.reduceat(v, heads)
            at = np.where(v == np.repeat(top, self.degree[nodes]), np.arange(len(v)), len(v))
            best[node[nodes]] = top
            back[node[nodes]] = np.minimum.reduceat(at, heads) + edges.start

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            word = np.flatnonzero(np.isfinite(best[last]) & (last > first))
            at = last[word]
            while len(word):
                edge = back[at]
                yield word, edge
                on = start[edge] > first[word]
                word, at = word[on], start[edge[on]]

        return best[last], parts()


_LATTICES = "sizes binary, degree binary, span binary, piece binary, freq binary"


def _rows_of(made: list[tuple[Lattices, np.ndarray]]) -> pa.RecordBatch:
    columns = [[np.ascontiguousarray(getattr(x, n)).tobytes() for x, _ in made] for n in ("sizes", "degree", "span", "piece")]
    columns.append([freq.astype(np.float64).tobytes() for _, freq in made])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["sizes", "degree", "span", "piece", "freq"])


def _lattices_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Lattices, np.ndarray]]:
    for b in batches:
        for *parts, freq in zip(*b.columns, strict=True):
            yield Lattices(*(np.frombuffer(x.as_buffer(), np.int32) for x in parts)), np.frombuffer(freq.as_buffer())


def _lattices(words: DataFrame, index: Broadcast, longest: int) -> DataFrame:
    """The lattices of (word, freq), some thousand words a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                made = Lattices.of(part.column(0).to_pylist(), index.value, longest)
                yield _rows_of([(made, part.column(1).to_numpy())])

    return words.select("word", "freq").mapInArrow(run, _LATTICES)


def _fewer(lattices: DataFrame, scores: np.ndarray) -> DataFrame:
    shared = lattices.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lattice, freq in _lattices_in(batches):
            yield _rows_of([(lattice.without(shared.value), freq)])

    return lattices.mapInArrow(run, _LATTICES)


def _sum_over_words(lattices: DataFrame, scores: np.ndarray, viterbi: bool) -> np.ndarray:
    """Expected or best-path use of each piece, weighted by word frequency."""
    shared = lattices.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums = np.zeros(len(known))
        for lattice, freq in _lattices_in(batches):
            if viterbi:
                for word, edge in lattice.best(known)[1]:
                    np.add.at(sums, lattice.piece[edge], freq[word])
            elif len(lattice.piece):
                sums += np.bincount(lattice.piece, lattice.expected(known, freq), len(known))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["piece", "weight"])

    made = lattices.mapInArrow(run, "piece int, weight double").groupBy("piece").agg(F.sum("weight").alias("weight")).toArrow()
    shared.unpersist()
    out = np.zeros(len(scores))
    out[made["piece"].to_numpy()] = made["weight"].to_numpy()
    return out


def _expected(word: str, scores: dict, span: int) -> dict:
    """Expected use of each piece over all splits of a word."""
    pieces = sorted(scores)
    lattice = Lattices.of([word], {p: i for i, p in enumerate(pieces)}, span)
    uses = lattice.expected(np.array([scores[p] for p in pieces]), np.ones(1))
    out = defaultdict(float)
    for p, use in zip(lattice.piece.tolist(), uses.tolist(), strict=True):
        out[pieces[p]] += use
    return out


def _digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma: shifted by seven, then the asymptotic series."""
    y = x + 7.0
    shift = sum((1.0 / (x + float(k)) for k in range(1, 7)), 1.0 / x)
    inv = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - inv * (1 / 12.0 - inv * (1 / 120.0 - inv / 252.0)) - shift


def _maximise(expected: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Scores of pieces; -inf for those that are hardly used."""
    kept = expected >= least
    out = np.full(len(expected), -np.inf)
    if kept.any():
        out[kept] = _digamma(expected[kept]) - _digamma(expected[kept].sum())
    return out


def _losses(index: Broadcast, scores: np.ndarray, uses: np.ndarray, longest: int, spark: SparkSession) -> DataFrame:
    """(piece, loss) of the pieces that are worth keeping: they are characters, or used and their own best split."""
    shared, n = spark.sparkContext.broadcast((scores, uses)), len(scores)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = list(index.value)
        known, used = shared.value
        total = used.sum()
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                ids = b.column(0).slice(at, BLOCK).to_numpy()
                ids = ids[np.isfinite(known[ids])]
                char = np.array([len(pieces[i]) == 1 for i in ids], bool)
                long = ids[~char & (used[ids] > 0)]
                lattice = Lattices.of([pieces[i] for i in long], index.value, longest, whole=False)
                other, parts = lattice.best(known)
                f, alone, k = used[long], np.zeros(len(long)), np.zeros(len(long))
                for word, edge in parts:
                    alone[word] += np.log(used[lattice.piece[edge]] + f[word])
                    k[word] += 1
                loss = f / total * ((np.log(f) - math.log(total)) - (alone - k * np.log(total + f * (k - 1)))) if len(long) else f
                loss[k == 0] = np.inf
                own = known[long] >= other
                out = np.concatenate([ids[char], long[own]]), np.concatenate([np.full(char.sum(), np.inf), loss[own]])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["piece", "loss"])

    return spark.range(0, n, 1, tasks_for(n, BLOCK)).mapInArrow(run, "piece long, loss double")


def _prune(lattices: DataFrame, index: Broadcast, scores: np.ndarray, keep: int, longest: int) -> np.ndarray:
    """Keep the pieces whose removal would cost most; characters always stay."""
    uses = _sum_over_words(lattices, scores, viterbi=True)
    losses = _losses(index, scores, uses, longest, lattices.sparkSession)
    best = losses.orderBy(F.desc("loss"), "piece").limit(keep).toArrow()["piece"].to_numpy()  # pieces are numbered in order
    out = np.full(len(scores), -np.inf)
    out[best] = scores[best]
    return out


def train_unigram(
    counts: DataFrame, vocab_size: int = 8000, seed_size: int = 1_000_000, shrink: float = 0.75,
    em_rounds: int = 2, max_piece: int = 16,
) -> DataFrame:
    """Vocabulary of scored pieces: specials, then pieces from the most probable on."""
    spark = counts.sparkSession
    counted = counts.where(F.length("word") > 0).select("word", "freq").persist(StorageLevel.MEMORY_AND_DISK)
    words = cut_lineage(counted.repartition(tasks_for(counted.count(), WORDS_PER_TASK), "word"))
    counted.unpersist()
    seeds = seed_pieces(words, seed_size, max_piece).toArrow().sort_by("piece")
    pieces, freq = seeds["piece"].to_pylist(), seeds["freq"].to_pylist()
    longest = max(map(len, pieces), default=1)
    index = spark.sparkContext.broadcast({p: i for i, p in enumerate(pieces)})
    chars = np.array([len(p) == 1 for p in pieces], bool)
    total = math.log(sum(freq)) if freq else 0.0
    scores = np.array([math.log(n) - total for n in freq])
    lattices = _lattices(words, index, longest).persist(StorageLevel.DISK_ONLY)
    size, target = len(scores), int(vocab_size * 1.1)
    while size:
        for _ in range(em_rounds):
            floor = scores[np.isfinite(scores)].min() - 1.0
            scores = _maximise(_sum_over_words(lattices, scores, viterbi=False))
            scores[chars & np.isinf(scores)] = floor
        held = int(np.isfinite(scores).sum())
        if held <= target:
            break
        kept = _prune(lattices, index, scores, max(target, int(held * shrink)), longest)
        done = np.isfinite(kept).sum() == held
        scores = kept
        if done:
            break
        if 2 * held <= size:  # edges of pieces that are gone are left out from time to time
            size, whole = held, lattices
            lattices = _fewer(whole, scores).persist(StorageLevel.DISK_ONLY)
            lattices.count()
            whole.unpersist()
    lattices.unpersist()
    ranked = sorted(np.flatnonzero(np.isfinite(scores)).tolist(), key=lambda i: (not chars[i], -scores[i], i))
    ranked = sorted(ranked[: vocab_size - len(SPECIALS)], key=lambda i: (-scores[i], i))
    rows = [(t, i, 0.0, "special") for i, t in enumerate(SPECIALS)]
    rows += [(pieces[p], i + len(SPECIALS), float(scores[p]), "piece") for i, p in enumerate(ranked)]
    return spark.createDataFrame(rows, "token string, id int, score double, kind string")
