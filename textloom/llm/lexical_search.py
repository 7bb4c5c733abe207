"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are read once into a forward index of the queries' terms; statistics come from partial sums of that pass. Each task
then indexes its documents in slices. A slice has the postings of each term with their impacts, and for chosen pairs of terms
the list of documents that hold both, with the greatest joint impact. A query's terms fall into pairs and single terms. The
most that a pair adds to any document is the greatest of its joint maximum and its two own maxima, which is below their sum
wherever no document has both at their best, so that more of a query's terms are skipped than under independent maxima:

* units (pairs, single terms) whose bounds together stay below the threshold are not essential;
* the postings of the others are traversed, which gives the candidates and lifts the threshold;
* the units left are probed, the greatest bound first, only for candidates that can still reach the threshold. The list of
  a pair tells which candidates hold both terms; the others can only have the better one of the two.

The threshold is the k-th best score so far of a task, ties stay in. Tasks give their k best, and these are merged. All
arithmetic is in 64-bit integers but for the logarithm of a term's weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.store import written

SLICE = 16_384
#: Distinct query terms that are broadcast at a time; queries with more of them are answered in several passes.
TERMS = 500_000
_MERGES = 64
_SPACE = 32
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else _SPACE for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters than ASCII ones, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _query_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted(set(terms(x.as_py()))) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(found, pa.list_(pa.binary())), pa.array([len(x) for x in found], pa.int64())],
            names=["q", "terms", "size"],
        )


_INDEX = "kind int, doc_id long, n long, tids array<int>, tfs array<long>"


def _index_batch(kind: list, ids: list, ns: list, tids: list, tfs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(kind, pa.int32()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
        pa.array(tids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64())),
    ], names=["kind", "doc_id", "n", "tids", "tfs"])


def _forward(vocabulary):
    """Kind 0: a document's query terms and their counts; kind 1: a task's documents (doc_id) and terms (n), and its df."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value.get
        df = np.zeros(len(vocabulary.value), np.int64)
        n_docs = n_terms = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids, ns, tids, tfs = [], [], [], []
                for ident, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    words = terms(text.as_py())
                    if not words:
                        continue
                    n_docs, n_terms = n_docs + 1, n_terms + len(words)
                    hit = [t for t in map(known, words) if t is not None]
                    if hit:
                        t, tf = np.unique(np.array(hit, np.int32), return_counts=True)
                        df[t] += 1
                        ids.append(ident), ns.append(len(words)), tids.append(t), tfs.append(tf.astype(np.int64))
                if ids:
                    yield _index_batch([0] * len(ids), ids, ns, tids, tfs)
        at = np.flatnonzero(df).astype(np.int32)
        yield _index_batch([1], [n_docs], [n_terms], [at], [df[at]])

    return run


class Slice:
    """The inverted index of some documents, with the lists of term pairs.

    ``first[t]:first[t + 1]`` are term t's postings; ``joint[p]`` is pair p's (documents, joint impacts, their maximum).
    """

    def __init__(self, ids, docs, tids, impacts, n_terms: int, pairs: np.ndarray):
        order = np.argsort(tids, kind="stable")
        self.ids, self.docs, self.impacts = ids, docs[order], impacts[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(tids, minlength=n_terms))])
        self.most = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impacts, self.first[held])
        place = np.full(len(ids), -1, np.int64)
        self.joint = []
        for a, b in pairs:
            (da, ia), (db, ib) = self.postings(a), self.postings(b)
            if not len(da) or not len(db):
                self.joint.append((da[:0], ia[:0], 0))
                continue
            place[da] = np.arange(len(da))
            at = place[db]
            both = at >= 0
            total = ia[at[both]] + ib[both]
            place[da] = -1
            self.joint.append((db[both], total, int(total.max(initial=0))))

    def postings(self, t: int):
        part = slice(self.first[t], self.first[t + 1])
        return self.docs[part], self.impacts[part]


def _probe(docs: np.ndarray, impacts: np.ndarray, cand: np.ndarray):
    """Which candidates a list holds, and their impacts (0: not held)."""
    if not len(docs):
        return np.zeros(len(cand), bool), np.zeros(len(cand), np.int64)
    at = np.minimum(np.searchsorted(docs, cand), len(docs) - 1)
    held = docs[at] == cand
    return held, np.where(held, impacts[at], 0)


def slice_best(s: Slice, singles: np.ndarray, pairs: np.ndarray, ends: np.ndarray, k: int, bar: int):
    """(documents of the slice, scores) of at least ``bar`` and above 0 that may be among a query's k best.

    ``pairs`` are numbers of pair lists and ``ends`` their two terms.
    """
    units = [(int(s.most[t]), -1, t, t) for t in singles if s.most[t]]
    for p, (a, b) in zip(pairs, ends, strict=True):
        bound = max(s.joint[p][2], int(s.most[a]), int(s.most[b]))
        if bound:
            units.append((bound, p, a, b))
    units.sort(key=lambda u: u[0])
    rest = np.cumsum([u[0] for u in units]) if units else np.zeros(0, np.int64)
    if not len(rest) or rest[-1] < bar:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    skip = int(np.searchsorted(rest, bar))  # units below ``skip`` can't lift a document to the bar by themselves
    score = np.zeros(len(s.ids), np.int64)
    for _, p, a, b in units[skip:]:
        for t in (a,) if p < 0 else (a, b):
            docs, impacts = s.postings(t)
            score[docs] += impacts
    cand = np.flatnonzero(score)
    if len(cand) > k:
        bar = max(bar, int(np.partition(score[cand], len(cand) - k)[len(cand) - k]))
    left = int(rest[skip - 1]) if skip else 0
    for bound, p, a, b in reversed(units[:skip]):
        cand = cand[score[cand] + left >= bar]
        if not len(cand):
            break
        left -= bound
        if p < 0:
            score[cand] += _probe(*s.postings(a), cand)[1]
            continue
        both, total = _probe(s.joint[p][0], s.joint[p][1], cand)
        score[cand] += total
        one = cand[~both]
        one = one[score[one] + max(int(s.most[a]), int(s.most[b])) + left >= bar]
        score[one] += _probe(*s.postings(a), one)[1] + _probe(*s.postings(b), one)[1]
        cand = np.concatenate([cand[both], one])
    cand = cand[score[cand] >= max(bar, 1)]
    return cand, score[cand]


def _ranked(ids: np.ndarray, missing: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort([ids, missing, -score])[:k]


def pair_up(tids: np.ndarray, df: np.ndarray) -> list[tuple[int, int]]:
    """A query's terms in pairs: frequent terms, whose lists are the ones to skip, with the next frequent one."""
    order = sorted((t for t in tids.tolist() if df[t] > 0), key=lambda t: (-df[t], t))
    return [(min(a, b), max(a, b)) for a, b in zip(order[::2], order[1::2])]


def _search(shared, k: int, size: int):
    """A task's k best documents of each query, from an index of a slice of its documents at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, pairs, weights, n_docs, n_terms = shared.value
        best: dict[int, tuple] = {}

        def answer(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts).combine_chunks()
            missing = np.asarray(t["doc_id"].is_null())
            ids = t["doc_id"].fill_null(0).to_numpy()
            lists = t["tids"].combine_chunks()
            tids = lists.flatten().to_numpy()
            tf = t["tfs"].combine_chunks().flatten().to_numpy()
            docs = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
            m = 10 + (90 * t["n"].to_numpy() * n_docs) // n_terms
            impacts = weights[tids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
            s = Slice(ids, docs, tids, impacts, len(weights), pairs)
            for q, (singles, numbers) in queries.items():
                held = best.get(q)
                bar = int(held[2][-1]) if held is not None and len(held[2]) == k else 1
                at, score = slice_best(s, singles, numbers, pairs[numbers], k, bar)
                if not len(at):
                    continue
                new = (ids[at], missing[at], score)
                if held is not None:
                    new = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                top = _ranked(*new, k)
                best[q] = tuple(x[top] for x in new)

        parts, rows = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                parts.append(b)
                rows += b.num_rows
                if rows >= size:
                    answer(parts)
                    parts, rows = [], 0
        if rows:
            answer(parts)
        task = TaskContext.get().partitionId() % _MERGES
        for q, (ids, missing, score) in best.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ids), q)), pa.array(ids, mask=missing), pa.array(score),
                pa.array(np.full(len(ids), task, np.int32)),
            ], names=["q", "doc_id", "score", "task"])

    return run


def _pass(docs: DataFrame, queries: list, k: int, size: int) -> DataFrame:
    """(q, doc_id, score, task): candidates of one block of queries."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    words = sorted({w for r in queries for w in r.terms})
    ident = {bytes(w): i for i, w in enumerate(words)}
    index = written(docs.mapInArrow(_forward(sc.broadcast(ident)), _INDEX))
    sums = index.where("kind = 1")
    n_docs, n_terms = sums.agg(F.sum("doc_id"), F.sum("n")).first()
    if not n_terms:
        return spark.createDataFrame([], "q long, doc_id long, score long, task int")
    df = np.zeros(len(words), np.int64)
    counts = sums.select(F.explode(F.arrays_zip("tids", "tfs")).alias("e")).groupBy("e.tids").agg(F.sum("e.tfs").alias("df"))
    for r in counts.toLocalIterator():  # at most one row for each term of the block
        df[r.tids] = r.df
    weights = np.array([weight(n_docs, d) for d in df], np.int64)
    numbers: dict[tuple[int, int], int] = {}
    parsed = {}
    for r in queries:
        own = np.array([ident[bytes(w)] for w in r.terms], np.int64)
        found = pair_up(own, df)
        at = np.array([numbers.setdefault(p, len(numbers)) for p in found], np.int64)
        paired = {t for p in found for t in p}
        parsed[r.q] = (np.array([t for t in own if df[t] and t not in paired], np.int64), at)
    pairs = np.array(list(numbers), np.int64).reshape(-1, 2)
    shared = sc.broadcast((parsed, pairs, weights, n_docs, n_terms))
    rows = index.where("kind = 0").select("doc_id", "n", "tids", "tfs")
    return rows.mapInArrow(_search(shared, k, size), "q long, doc_id long, score long, task int")


def search(docs: DataFrame, items: DataFrame, k: int = 10, size: int = SLICE, terms_each: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, all if there are fewer.

    Each row of ``docs`` (doc_id, text) is a document, each row of ``items`` (item_id, text) a query, whatever their ids;
    repeated rows are found again. Null texts and texts without terms are found by nothing, find nothing and count in no
    statistic. Equal scores go by doc_id, null last. Other columns are ignored. Items are split into blocks of about
    ``terms_each`` terms, each a pass over the documents, so that no broadcast outgrows that.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    items = written(items.select("item_id", "text").withColumn("q", F.monotonically_increasing_id()))
    parsed = written(items.select("q", "text").mapInArrow(_query_terms, "q long, terms array<binary>, size long").where("size > 0"))
    blocks = max(1, -(-(parsed.agg(F.sum("size")).first()[0] or 0) // terms_each))
    found = None
    for b in range(blocks):
        queries = parsed.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        if queries:
            part = _pass(docs, queries, k, size)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "q long, doc_id long, score long, task int")
    best = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for keys in (("q", "task"), ("q",)):  # merged in two levels, so that no window holds a row of every task
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
        found = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return found.join(items.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
