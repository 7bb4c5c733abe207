"""Exact top-k search by MaxScore over shards.

A term is a dimension; a query's weight times a posting's value is its contribution. In each shard a query's terms are
ordered by the bound of their contributions (the larger of weight * least and weight * greatest value, less the smaller).
The essential terms are those whose bounds, with the rest at their worst, can lift a vector over the query's threshold; their
postings are traversed for all vectors of the shard, in blocks. The other terms are probed one after another, and only for
vectors that can still reach the threshold. The threshold is the k-th best score of the blocks before; ties stay in. Shards
give their k best, and these are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.store import written

SHARD, QUERIES, BLOCK = 8192, 256, 1024
_NONE = -(1 << 62)


def integer_vector(x: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component, in double precision; null for null, or null or non-finite components."""
    wide = F.transform(x, lambda v: v.cast("double"))
    fine = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(wide, lambda v: F.floor(v * factor).cast("long")))


def shard_best(query: np.ndarray, own: int, ids: np.ndarray, postings: np.ndarray, k: int, floor: int = _NONE):
    """(ids, scores) of a query's k best in a shard, best first, ties to the smaller id; ``own`` is left out.

    ``postings`` has a row for each term, ``ids`` are ascending.
    """
    low, high = postings.min(1), postings.max(1)
    worst, best = np.minimum(query * low, query * high), np.maximum(query * low, query * high)
    order = np.argsort(worst - best, kind="stable")  # largest bound first
    after = np.concatenate([np.cumsum(best[order][::-1])[::-1], [0]])  # the most that terms from here on can add
    top_i, top_s = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bar = floor
    for at in range(0, len(ids), BLOCK):
        part = slice(at, at + BLOCK)
        alive = np.flatnonzero(ids[part] != own)
        score = np.zeros(len(ids[part]), np.int64)
        # essential: while the terms left could still lift a vector without them over the bar
        gain = np.cumsum(best[order] - worst[order])
        essential = int(np.searchsorted(gain, gain[-1] + worst.sum() - bar, "left")) if bar > _NONE else len(order)
        essential = min(max(essential, 1), len(order))
        head = order[:essential]
        score += query[head] @ postings[head, part]
        for n in range(essential, len(order)):
            alive = alive[score[alive] + after[n] >= bar]
            if not len(alive):
                break
            score[alive] += query[order[n]] * postings[order[n], part][alive]
        alive = alive[score[alive] >= bar]
        top_i, top_s = np.concatenate([top_i, ids[part][alive]]), np.concatenate([top_s, score[alive]])
        best_k = np.lexsort([top_i, -top_s])[:k]
        top_i, top_s = top_i[best_k], top_s[best_k]
        if len(top_s) == k:
            bar = max(bar, top_s[-1])
    return top_i, top_s


def _search(k: int):
    def run(key, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(shard):
            shard = shard.sort_values("vec_id", kind="stable")
            ids = shard["vec_id"].to_numpy(np.int64)
            postings = np.ascontiguousarray(np.stack(shard["x"].to_numpy()).astype(np.int64).T)
            for q, x in zip(queries["vec_id"], queries["x"], strict=True):
                i, s = shard_best(np.asarray(x, np.int64), q, ids, postings, k)
                out.append(pd.DataFrame({"query_id": q, "vec_id": i, "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k vectors with the greatest inner product, all if there are fewer.

    Both tables have vec_id and x, an array of integers. A query never finds its own vec_id. Null and empty vectors, and
    rows without vec_id, take no part; vectors of another length than the query's are no candidates. Repeated rows of
    a candidate are candidates each; a repeated query is answered once. Scores are 64-bit.
    """
    spark = vectors.sparkSession
    take = lambda df: df.where("vec_id is not null and size(x) > 0").select(F.col("vec_id").cast("long"), "x")
    vectors, queries = written(take(vectors)), written(take(queries).dropDuplicates(["vec_id"]))
    shards, blocks = max(1, -(-vectors.count() // shard)), max(1, -(-queries.count() // block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    size = F.size("x").alias("d")
    q = queries.select("vec_id", "x", size, deal(blocks).alias("b"), all_of(shards).alias("s"))
    v = vectors.select("vec_id", "x", size, all_of(blocks).alias("b"), deal(shards).alias("s"))
    met = q.groupBy("d", "b", "s").cogroup(v.groupBy("d", "b", "s")).applyInPandas(
        _search(k), "query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
