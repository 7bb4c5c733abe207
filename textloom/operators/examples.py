"""Training examples: sharding, truncation, framing, span masking, shuffled batches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import arrays as ar
from textloom.functions.hashing import digest, uniform_from
from textloom.functions.words import CLS, MASK, PAD, SEP
from textloom.operators.ordered import LineOrder, scan

IGNORED = -100
_ATTEMPTS = 100


def shard_of(line_no: Column, n_shards: int) -> Column:
    return F.pmod(line_no, F.lit(n_shards)).cast("int")


def truncate(ids: Column, seq_length: int) -> Column:
    return ar.head(ids, seq_length - 2)


def shorten_at_random(ids: Column, seq_length: int, short_p: float, *key) -> Column:
    """With probability ``short_p`` keep a uniform 1 .. seq_length-3 tokens."""
    d = digest(*key, "short")
    room = seq_length - 2
    short = F.lit(1) + F.floor(uniform_from(d, 1) * (room - 1)).cast("int")
    return ar.head(ids, F.when(uniform_from(d, 0) > short_p, F.lit(room)).otherwise(short))


def frame_and_pad(ids: Column, seq_length: int, cls: int = CLS, sep: int = SEP, pad: int = PAD) -> Column:
    return ar.pad(ar.frame(ids, cls, sep), seq_length, pad)


def build_examples(segments: DataFrame, seq_length: int, short_p: float = 0.0, seed: int = 0, epoch: int = 0, id_col: str = "seg_id") -> DataFrame:
    """Fixed-length ``input_ids`` and ``is_pad`` (True on padding) from an ``ids`` column."""
    kept = truncate(F.col("ids"), seq_length)
    if short_p > 0:
        kept = shorten_at_random(kept, seq_length, short_p, seed, epoch, F.col(id_col))
    rows = segments.withColumn("_kept", kept)
    return rows.withColumns({
        "input_ids": frame_and_pad(F.col("_kept"), seq_length),
        "is_pad": ar.padding_mask(F.size("_kept") + 2, seq_length),
    }).drop("_kept")


def _draws(keys: list, suffix: str) -> np.ndarray:
    """Four numbers in [0, 1) per key, the same that ``uniform_from`` reads from the digest."""
    raw = b"".join(hashlib.md5((k + suffix).encode()).digest() for k in keys)
    return np.frombuffer(raw, dtype=">u4").reshape(-1, 4) / 4294967296.0


def _binomial(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Inverse distribution function of Binomial(n, p)."""
    out = np.zeros(len(n), dtype=np.int64)
    for size in np.unique(n):
        pmf = (1.0 - p) ** int(size)
        cdf = [pmf]
        for i in range(int(size) - 1):
            pmf = pmf * (size - i) / (i + 1) * (p / (1.0 - p))
            cdf.append(cdf[-1] + pmf)
        here = n == size
        out[here] = np.searchsorted(np.array(cdf[: int(size)]), u[here], side="right")
    return out


def _choose_spans(maskable: np.ndarray, keys: list, mask_p: float, random_p: float, keep_p: float) -> np.ndarray:
    """0 untouched, 1 masked, 2 random id, 3 kept, for every position of every row at once.

    Spans of geometric length (mod 10) start anywhere, also partly outside; each span draws one
    action; a later span overrides an earlier one; the last position is never touched; a row
    stops once enough positions are chosen or after a hundred spans.
    """
    n_rows, length = maskable.shape
    n = maskable.sum(axis=1)
    wanted = np.minimum(n, np.maximum(1, _binomial(n, mask_p, _draws(keys, ":count")[:, 0])))
    state = np.zeros((n_rows, length), dtype=np.int8)
    done = np.zeros(n_rows, dtype=np.int64)
    at = np.arange(length)
    for attempt in range(1, _ATTEMPTS + 1):
        open_rows = np.flatnonzero(done < wanted)
        if not len(open_rows):
            break
        u = _draws([keys[i] for i in open_rows], f":{attempt}")
        span = np.maximum(np.ceil(np.log(1.0 - u[:, 0]) / math.log(2.0 / 3.0)), 1).astype(np.int64) % 10
        start = (1 - span) + np.floor(u[:, 1] * (length + 2 * span - 1)).astype(np.int64)
        end = np.minimum(length - 1, start + span)
        action = np.where(u[:, 2] < 1.0 - random_p - keep_p, 1, np.where(u[:, 2] < 1.0 - keep_p, 2, 3))
        covered = (at >= start[:, None]) & (at < end[:, None]) & maskable[open_rows]
        state[open_rows] = np.where(covered, action[:, None], state[open_rows])
        done[open_rows] = (state[open_rows] > 0).sum(axis=1)
    return state


def mask_spans(
    examples: DataFrame, vocab_size: int, mask_p: float = 0.15, random_p: float = 0.1, keep_p: float = 0.1,
    n_special: int = 6, seed: int = 0, epoch: int = 0, id_col: str = "seg_id", mask_id: int = MASK,
) -> DataFrame:
    """Masked ``inputs`` and ``labels`` (original id where chosen, -100 elsewhere).

    All rows of an Arrow batch are masked together; rows have the fixed example length. Each
    random number comes from a digest of (seed, epoch, row id, purpose), so the result does not
    depend on partitioning or retries.
    """
    out = T.ArrayType(T.IntegerType())
    schema = T.StructType([*examples.schema.fields, T.StructField("inputs", out), T.StructField("labels", out)])
    low = n_special - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lists = batch.column("input_ids")
            ids = lists.flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1), dtype=np.int32)
            keys = [f"{seed}:{epoch}:{i}" for i in batch.column(id_col).to_pylist()]
            state = _choose_spans(ids >= n_special, keys, mask_p, random_p, keep_p)
            inputs = np.where(state == 1, mask_id, ids)
            rows, cols = np.nonzero(state == 2)
            if len(rows):
                u = np.concatenate([_draws([keys[r]], f":id{c}")[:, 0] for r, c in zip(rows, cols)])
                inputs[rows, cols] = low + np.floor(u * (vocab_size - low)).astype(np.int64)
            labels = np.where(state > 0, ids, IGNORED)
            offsets = pa.array(np.arange(n + 1) * ids.shape[1], type=pa.int32())
            made = [
                pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)[: n * ids.shape[1]].astype(np.int32)))
                for x in (inputs, labels)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], names=[*batch.schema.names, "inputs", "labels"]
            )

    return examples.mapInArrow(run, schema)


def masked_positions(examples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, target) of the positions that count for the loss."""
    marked = F.transform("labels", lambda x, i: F.struct(i.alias("pos"), x.alias("target")))
    hit = F.filter(marked, lambda s: s["target"] != IGNORED)
    return examples.select(*keys, F.explode(hit).alias("h")).select(*keys, "h.pos", "h.target")


def epoch_batches(
    rows: DataFrame, batch_size: int, seed: int = 0, epoch: int = 0, n_shards: int = 1,
    shard: str = "shard", id_col: str = "seg_id", drop_last: bool = True,
) -> DataFrame:
    """Shuffle each shard by a seeded digest and cut it into batches; adds ``batch`` and ``slot``.

    The leading digest bits order the rows, so the position comes from the ranged scan and no
    task sorts a whole shard.
    """
    salt = F.lit(seed) + F.col(shard) + F.lit(epoch * n_shards)
    d = digest(salt, F.col(id_col))
    keyed = rows.withColumn("_turn", F.conv(F.substring(d, 1, 15), 16, 10).cast("bigint"))
    order = LineOrder((shard,), "_turn", (id_col,), (44,))
    placed = scan(keyed, order, add=F.lit(1))
    if drop_last:
        placed = placed.where(F.floor(F.col("before") / batch_size) < F.floor(F.col("total") / batch_size))
    return placed.withColumns({
        "batch": F.floor(F.col("before") / batch_size),
        "slot": F.pmod("before", F.lit(batch_size)).cast("int"),
    }).drop("_turn", "before", "total")


def ordered_batches(rows: DataFrame, order: LineOrder, batch_size: int) -> DataFrame:
    """Batches in the given order, the last one possibly short."""
    placed = scan(rows, order, add=F.lit(1))
    return placed.withColumn("batch", F.floor(F.col("before") / batch_size)).drop("before", "total")


def steps_per_epoch(rows: DataFrame, batch_size: int, shard: str = "shard") -> DataFrame:
    """Full batches of the shortest shard."""
    counts = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.floor(F.col("n") / batch_size)).alias("steps"), F.count(F.lit(1)).alias("shards"))


def random_example(rows: DataFrame, seed: int = 0, id_col: str = "seg_id") -> DataFrame:
    return rows.orderBy(digest(seed, "show", F.col(id_col)), id_col).limit(1)


def token_budget(steps: Column, shards: Column, batch_size: int, seq_length: int) -> Column:
    return (steps * shards * batch_size * seq_length).cast("bigint")


def resume_window(batches: DataFrame, steps_in_epoch: int, done_steps: int, max_steps: int, long_after: float = 1.0) -> DataFrame:
    """Batches still to run: after the finished steps, before the stop point."""
    step = F.col("epoch") * steps_in_epoch + F.col("batch")
    stop = min(max_steps, int(max_steps * long_after)) if done_steps < int(max_steps * long_after) else max_steps
    return batches.withColumn("step", step).where((F.col("step") >= done_steps) & (F.col("step") < stop))
