"""Quality classifier: Bradley-Terry ranking on document statistics.

A document's strength is w . x; a good document is preferred to a bad one with the chance sigmoid(w . (x_good - x_bad)).
Pairs come from labelled documents, w minimises the logistic loss of the pairs' feature differences. The threshold is the
quantile of the labelled strengths that leaves the labelled share of bad documents below it, and strengths map to a score
that is 0.7 there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

CUT = 0.7
#: Labelled documents that the fit may use; chosen by hash, so the choice is the same in every run.
MAX_LABELLED = 20_000
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line feed, 6 light, 7 heavy punctuation, 8 high
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[[32, 9]], _CLASS[10], _CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 4, 5, 6
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS[128:] = 8
N_FEATURES = 24


def features(data: bytes) -> np.ndarray:
    """Statistics of a whole text that do not depend on its language: shares of byte classes, word and line repetition."""
    n = len(data)
    if not n:
        return np.zeros(N_FEATURES, np.float32)
    share = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9) / n
    words = data.split()
    m = len(words)
    if not m:
        return np.concatenate([share, np.zeros(N_FEATURES - 9)]).astype(np.float32)
    sizes = np.fromiter(map(len, words), np.int64, m)
    different = len(set(words))
    same_next = sum(map(bytes.__eq__, words, words[1:])) / max(m - 1, 1)
    lines = [x for x in data.split(b"\n") if x]
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m
    shout = sum(w.isupper() for w in words) / m
    capital = sum(w[:1].isupper() for w in words) / m
    return np.concatenate([
        share,
        [
            same_next, same_next > 0.2, different / m, different / m**0.75, marked, marked > 0.6, shout, shout > 0.3, capital,
            sizes.mean() / 10, sizes.std() / 10, min(sizes.max(), 200) / 100,
            len(set(lines)) / max(len(lines), 1), np.log1p(m) / 10, (sizes == 1).mean(),
        ],
    ]).astype(np.float32)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Score in 0 to 1, rising with the strength and CUT at the threshold."""
        z = self.slope * (self.strengths(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_pairs(diff: np.ndarray, penalty: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights that minimise the mean logistic loss of preference differences, by Newton's method."""
    n, d = diff.shape
    w = np.zeros(d)

    def loss(v: np.ndarray) -> float:
        return np.logaddexp(0, -diff @ v).mean() + penalty / 2 * v @ v

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        grad = -(diff * p[:, None]).mean(0) + penalty * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + penalty * np.eye(d)
        step = np.linalg.solve(hess, grad)
        t = 1.0
        while loss(w - t * step) > now and t > 1e-6:
            t /= 2
        w = w - t * step
        if now - (now := loss(w)) < 1e-9:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray, pairs_each: int = 8, seed: int = 7) -> Ranker:
    """Ranker from features and 0/1 labels; each labelled document meets ``pairs_each`` of the other label.

    With one label only, or none, every score is above CUT or equal: nothing can be told to be bad.
    """
    x, label = np.asarray(x, float).reshape(-1, N_FEATURES), np.asarray(label)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    draw = np.random.default_rng(seed)
    one = np.concatenate([np.repeat(good, pairs_each), draw.choice(good, pairs_each * len(bad))])
    two = np.concatenate([draw.choice(bad, pairs_each * len(good)), np.repeat(bad, pairs_each)])
    w = fit_pairs(z[one] - z[two])
    strength = z @ w
    # the quantile of the bad share; on separable labels the middle of the gap around it
    order = np.sort(strength)
    low, high = order[len(bad) - 1], order[min(len(bad), len(order) - 1)]
    return Ranker(mean, scale, w, float((low + high) / 2), 1.0)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker:
    """Ranker from the texts of labelled documents; labels are (doc_id, quality).

    At most ``max_labelled`` labels are used, chosen by hash; only their ids are broadcast and only their features reach the
    driver. Labels other than 0 and 1 are left out; a document with several labels has the smallest one.
    """
    own = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(d or b"").tobytes() for d in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["key", "quality", "x"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_data")).join(F.broadcast(own), "doc_id")
    rows = rows.select(F.xxhash64("doc_id", "_data").alias("key"), F.col("quality").cast("int"), "_data")
    found = rows.mapInArrow(run, "key long, quality int, x binary").dropDuplicates(["key"]).collect()
    found.sort(key=lambda r: r[0])
    data = np.array([np.frombuffer(r[2], np.float32) for r in found]).reshape(-1, N_FEATURES)
    return fit(data, np.array([r[1] for r in found]))


def scored(docs: DataFrame, ranker: Ranker, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of the rows, with score and predicted."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("_data"))
    schema = StructType([*rows.drop("_data").schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(d or b"") for d in b.column(b.num_columns - 1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ranker.scores(x))], names=[*keep, "score"])

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def judged(docs: DataFrame, labels: DataFrame, held_out: str | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows with held_out, score and predicted; labels of rows where ``held_out`` holds aren't learnt.

    ``held_out`` is an SQL condition on doc_id. Null and empty texts have a score like any other; a null doc_id is not
    held out and never labelled. Repeated rows come back repeated, and an empty table gives none. Labels, lang, source and
    doc_id are no features. Columns with the new names are replaced.
    """
    out = F.coalesce(F.expr(held_out or "false"), F.lit(False))
    ranker = train(docs, labels.where(~out), max_labelled)
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    return scored(docs, ranker, keep).withColumn("held_out", out)


def classify(docs: DataFrame, labels: DataFrame, held_out: str | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, as in ``judged``."""
    out = F.coalesce(F.expr(held_out or "false"), F.lit(False))
    ranker = train(docs, labels.where(~out), max_labelled)
    return scored(docs, ranker, ["doc_id"]).select("doc_id", out.alias("held_out"), "score", "predicted")
